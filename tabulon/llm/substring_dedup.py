"""Repeated passages across documents by chaining shared k-mer seeds."""

from __future__ import annotations

import itertools
import tempfile
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_names, in_batches, one_text, quoted, repeats, restrict
from .kernels import LOWER, STEP, chunks, mix, text_buffer, windows, word_hashes, words

#: Words of a seed; of seeds those are kept whose first or last word has their least hash (closed syncmers).
K = 5
#: Of so many seeds in a row at least one is kept: K + WINDOW - 1 words that two texts share hold a shared seed.
WINDOW = K - 1
#: Words of the shortest passage, and the share of them that must agree.
LEAST = 50
SIMILARITY = 0.75
#: Words that a gap may span in either text before it costs more than a seed gains; beyond twice that a chain is parted.
GAP = 48
#: Matches on one diagonal no further apart are one node of a chain.
NEAR = 16
#: Score that an extension may lose before it stops, and that of a word that doesn't agree (one that does: 1).
DROP = 12
APART = -1
#: Words that an extension may leave out in either text to go on.
SHIFT = 3
BEYOND = 3
#: Words looked at first around a chain; where the score hasn't dropped at their end, MORE times as many are.
MARGIN = 32
MORE = 16
#: Words of the blocks that texts are moved in.
BLOCK = 64

PASSAGE = "doc_id long, start_word long, end_word long, start_byte long, end_byte long, source_doc_id long, source_start_word long, source_end_word long, n_agreeing long, similarity double"
NAMES = [f.split()[0] for f in PASSAGE.split(", ")]
KINDS = [*[pa.int64()] * 9, pa.float64()]


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


# ---------------------------------------------------------------- seeds


def chosen(hashes: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Places of the kept seeds: closed syncmers, a choice that depends on the seed's own words only."""
    n = len(inside)
    least = hashes[:n].copy()
    for j in range(1, K):
        np.minimum(least, hashes[j : n + j], out=least)
    return np.flatnonzero(inside & ((least == hashes[:n]) | (least == hashes[K - 1 : n + K - 1])))


def numbered(seeds: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Seeds, a repeated one of a text joined with its number: the n-th occurrences of two texts then match.

    Without it a run of one word would match a single place of the other text.
    """
    if not len(seeds):
        return seeds
    own = mix(seeds + mix(text.astype(np.uint64) + np.uint64(0x51)))
    order = np.argsort(own, kind="stable")
    ordered = own[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if new.all():
        return seeds
    at = np.arange(len(seeds))
    number = np.empty(len(seeds), np.uint64)
    number[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(number > 0, mix(seeds + number * STEP), seeds)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds, numbered, with their word's place; of a repeated one also its later occurrences without their number (at: -1 - place)."""
    for whole in batches:
        for part in chunks(whole, "text"):
            data, offsets = text_buffer(part.column("text"))
            data = LOWER[data]
            starts, ends, ranges = words(data, offsets)
            hashes = word_hashes(data, starts, ends)
            value, inside = windows(hashes, ranges, K)
            place = chosen(hashes, inside)
            row = np.searchsorted(ranges, place, "right") - 1
            bare, at = value[place], (place - ranges[row]).astype(np.int32)
            seed = numbered(bare, row)
            again = np.flatnonzero(seed != bare)
            ids = part.column("doc_id").take(pa.array(np.concatenate([row, row[again]])))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([seed, bare[again]]).view(np.int64)), ids, pa.array(np.concatenate([at, -1 - at[again]]))], ["seed", "doc_id", "at"])


HITS = "seed long, doc_id long, at int, again array<int>, head long, source_at int, n long"
HIT = np.dtype([("seed", np.int64), ("doc_id", np.int64), ("at", np.int32)])
#: Rows that are sorted at once; where there are more, they are dealt into files by so many bits of their seeds.
HELD = 1 << 19
BITS = 4
#: Top bits of a seed by which the seeds are shuffled.
BUCKET_BITS = 10


def _hits(rows: np.ndarray, head: np.ndarray, source_at: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each place of a seed, without how many rows the seed has."""
    for low in range(0, len(rows), HELD >> 2):
        part = slice(low, low + (HELD >> 2))
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[part])) for c in (*(rows[c] for c in HIT.names), head, source_at)], [*HIT.names, "head", "source_at"])


def _by_text(rows: np.ndarray, head: np.ndarray, source_at: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each seed of a text: its first place, any others as `again` (null: none), and how many places the seed has in all texts.

    A text that repeats a phrase a thousand times then has one row for each of its seeds in all joins. Places are written as in _seeds().
    """
    if not len(rows):
        return
    order = np.lexsort((-rows["at"], rows["doc_id"], rows["seed"]))
    seed, doc, at = (np.ascontiguousarray(rows[c][order]) for c in HIT.names)
    new = np.concatenate([[True], (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    more = np.diff(np.append(first, len(at))) - 1
    again = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(more)]).astype(np.int32)), pa.array(at[~new]), mask=pa.array(more == 0))
    columns = [seed[first], doc[first], at[first], again, head[order][first], source_at[order][first], n[order][first]]
    whole = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [f.split()[0] for f in HITS.split(", ")])
    for low in range(0, len(first), HELD >> 2):
        yield whole.slice(low, HELD >> 2)


def _words_at(at: np.ndarray) -> np.ndarray:
    """Places as _seeds() writes them as words of the text."""
    return np.maximum(at, -1 - at)


def _least(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the groups of rows that begin at `first` the smallest doc_id, the first place there and the largest doc_id."""
    doc, at = np.ascontiguousarray(rows["doc_id"]), rows["at"]
    head = np.minimum.reduceat(doc, first)
    there = np.repeat(head, np.diff(np.append(first, len(doc)))) == doc
    return head, np.minimum.reduceat(np.where(there & (at >= 0), at, np.iinfo(np.int32).max), first), np.maximum.reduceat(doc, first)


class _Dealt:
    """Rows in a file, and the least and the largest seed of them."""

    def __init__(self) -> None:
        self.file, self.low, self.high = tempfile.TemporaryFile(), 1 << 63, -1 << 63

    def add(self, rows: np.ndarray) -> None:
        if len(rows):
            self.low, self.high = min(self.low, int(rows["seed"].min())), max(self.high, int(rows["seed"].max()))
            self.file.write(rows.tobytes())

    def parts(self) -> Iterator[np.ndarray]:
        self.file.seek(0)
        while raw := self.file.read((HELD >> 2) * HIT.itemsize):
            yield np.frombuffer(raw, HIT)

    def one_seed(self, give: Callable) -> Iterator[pa.RecordBatch]:
        """The hits of rows that all have one seed, however many they are."""
        least = [(*(int(x[0]) for x in _least(rows, np.zeros(1, np.int64))), len(rows)) for rows in self.parts()]
        (head, place), tail, n = min(x[:2] for x in least), max(x[2] for x in least), sum(x[3] for x in least)
        if head < tail:
            for rows in self.parts():
                yield from give(rows, np.full(len(rows), head), np.full(len(rows), place, np.int32), np.full(len(rows), n))


def _headed_rows(parts: Iterator[np.ndarray], level: int = 0, give: Callable = _hits) -> Iterator[pa.RecordBatch]:
    """Of rows those whose seed several documents have, with the smallest of these as head and the seed's first place there, in the form of `give`.

    At most HELD rows and a batch are held, whatever number of them has one seed.
    """
    held: list[np.ndarray] = []
    files: list[_Dealt] = []
    count = 0
    for part in itertools.chain(parts, [None]):
        if part is not None:
            held.append(part)
            count += len(part)
        if held and (files if part is None else count > HELD):
            files = files or [_Dealt() for _ in range(1 << BITS)]
            rows = np.concatenate(held)
            held, count = [], 0
            bits = (rows["seed"].view(np.uint64) >> np.uint64(BITS * level)).astype(np.uint8) & np.uint8((1 << BITS) - 1)
            ends = np.cumsum([0, *np.bincount(bits, minlength=1 << BITS)])
            rows = rows[np.argsort(bits, kind="stable")]
            for file, a, b in zip(files, ends[:-1], ends[1:], strict=True):
                file.add(rows[a:b])
    for dealt in files:
        with dealt.file:
            if dealt.low < dealt.high:
                yield from _headed_rows(dealt.parts(), level + 1, give)
            elif dealt.low == dealt.high:
                yield from dealt.one_seed(give)
    if held and len(rows := np.concatenate(held)):
        rows = rows[np.argsort(rows["seed"])]
        seed = rows["seed"]
        first = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
        head, place, tail = _least(rows, first)
        n = np.diff(np.append(first, len(seed)))
        of = np.repeat(np.arange(len(first)), n)
        take = np.flatnonzero((head < tail)[of])
        yield from give(rows[take], head[of[take]], place[of[take]], n[of[take]])


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The seeds of texts, those with the same top bits in one row, column by column: Spark then moves few rows."""
    held: list[np.ndarray] = []
    for part in itertools.chain(_seeds(batches), [None]):
        if part is not None:
            rows = np.empty(part.num_rows, HIT)
            for c in HIT.names:
                rows[c] = part.column(c).to_numpy()
            held.append(rows)
        if held and (part is None or sum(map(len, held)) > HELD >> 1):
            rows = np.concatenate(held)
            held = []
            bucket = (rows["seed"].view(np.uint64) >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16)
            ends = np.cumsum([0, *np.bincount(bucket, minlength=1 << BUCKET_BITS)])
            order = np.argsort(bucket, kind="stable")
            columns = [np.ascontiguousarray(rows[c][order]) for c in HIT.names]
            some = np.flatnonzero(np.diff(ends))
            raw = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(ends[some].tolist(), ends[some + 1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw, pa.binary())], ["bucket", "raw"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hits of all rows of a partition, which has all rows of each of its seeds, a row for each seed of a text (more than one only where over HELD rows have the seed)."""

    def parts() -> Iterator[np.ndarray]:
        for batch in batches:
            for raw in batch.column("raw"):
                data = raw.as_buffer()
                rows, at = np.empty(data.size // HIT.itemsize, HIT), 0
                for c in HIT.names:
                    rows[c] = np.frombuffer(data, HIT[c], len(rows), at)
                    at += HIT[c].itemsize * len(rows)
                yield rows

    yield from _headed_rows(parts(), give=_by_text)


def _headed(texts: DataFrame) -> DataFrame:
    """Seeds of texts that several documents have, with the smallest of these as head and the seed's first place there; shuffled once, sorted by numpy."""
    return cut(in_batches(in_batches(texts, _dealt, "bucket int, raw binary").repartition("bucket"), _shared, HITS))


# ---------------------------------------------------------------- chains

Node = tuple[int, int, int, int, int]


def nodes(anchors: Iterable[tuple[int, int]]) -> list[Node]:
    """Anchors (place in text, place in source) gathered to runs on one diagonal.

    A node has the places of its first and last seed in text and source, and the words that its seeds cover.
    """
    out: list[Node] = []
    diagonal, first, last, gain = None, 0, 0, 0
    for d, t in sorted({(t - s, t) for t, s in anchors}):
        if d == diagonal and t - last <= NEAR:
            gain += min(t - last, K)
            last = t
            continue
        if diagonal is not None:
            out.append((first, first - diagonal, last, last - diagonal, gain))
        diagonal, first, last, gain = d, t, t, K
    if diagonal is not None:
        out.append((first, first - diagonal, last, last - diagonal, gain))
    return out


def chains(found: list[Node], gap: int = GAP) -> list[list[Node]]:
    """Disjoint collinear chains of nodes, best first.

    A node gains the words it covers; a step costs K / (2 * gap) for every word it moves in either text, from
    the last seed of a node to the first of the next. The best predecessor is a prefix maximum over source
    places, held in a Fenwick tree that is filled in the order of text places.
    """
    found = sorted(found)
    places = sorted({n[3] for n in found})
    cost = K / (2 * gap)
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(places) + 1)
    score, before = [0.0] * len(found), [-1] * len(found)
    ending = sorted(range(len(found)), key=lambda i: found[i][2])
    done = 0
    for i, (t, s, _, _, gain) in enumerate(found):
        while done < len(ending) and found[ending[done]][2] < t:  # only nodes that end before in the text
            j = ending[done]
            done += 1
            at, entry = bisect_left(places, found[j][3]) + 1, (score[j] + cost * (found[j][2] + found[j][3]), j)
            while at <= len(places):
                if tree[at] < entry:
                    tree[at] = entry
                at += at & -at
        at, best = bisect_left(places, s), (-1e18, -1)
        while at:
            best = max(best, tree[at])
            at -= at & -at
        more = best[0] - cost * (t + s)
        score[i], before[i] = (gain + more, best[1]) if more > 0 else (gain, -1)
    out, taken = [], [False] * len(found)
    for i in sorted(range(len(found)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not taken[i]:
            taken[i] = True
            chain.append(found[i])
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def parted(chain: list[Node], gap: int = GAP) -> Iterator[list[Node]]:
    """The chain, cut where a gap spans more than twice `gap` words in a text."""
    part = [chain[0]]
    for node in chain[1:]:
        if max(node[0] - part[-1][2], node[1] - part[-1][3]) > 2 * gap:
            yield part
            part = []
        part.append(node)
    yield part


CHAIN = "doc_id long, source_id long, chain int, runs array<array<int>>"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.list_(pa.int32()))]
    for batch in batches:
        rows: list[tuple] = []
        for doc, source, at, source_at, again in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "head", "at", "source_at", "again")), strict=True):
            others = ((t, x["source_at"]) for x in again for t in x["again"])
            found = nodes((max(t, -1 - t), s) for t, s in itertools.chain(zip(at, source_at, strict=True), others))
            parts = [p for c in (chains(found) if len(found) > 1 else [found]) for p in parted(c)]
            for i, part in enumerate(p for p in parts if len(p) > 1 or p[0][4] > K):  # more than a single seed
                rows.append((doc, source, i, [n[:4] for n in part]))
        yield _table(rows, ["doc_id", "source_id", "chain", "runs"], kinds)


# ---------------------------------------------------------------- alignment


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in blocks of BLOCK whole words."""
    for whole in batches:
        for part in chunks(whole, "text"):
            data, offsets = text_buffer(part.column("text"))
            starts, _, ranges = words(data, offsets)
            n = np.diff(ranges)
            count = -(-n // BLOCK)
            row = np.repeat(np.arange(len(n)), count)
            block = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            low = starts[ranges[row] + block * BLOCK] if len(row) else np.zeros(0, np.int64)
            places = np.concatenate([low, [len(data)]]).astype(np.int32)  # a block goes on to the next one's first word
            raw = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(np.ascontiguousarray(data))])
            columns = [pa.array(block.astype(np.int32)), raw, pa.array(low - offsets[row]), pa.array(n[row].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), *columns], ["id", "block", "raw", "first_byte", "total"])


class Slice:
    """Words of consecutive blocks of a text: hashes, byte places, number of the first one, and how many the text has."""

    def __init__(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int, total: int):
        self.hashes, self.starts, self.ends, self.first, self.total = hashes, starts, ends, first, total
        self.last = first + len(hashes)

    def between(self, low: int, high: int) -> np.ndarray:
        return self.hashes[low - self.first : high - self.first]


def _slices(column: pa.Array) -> list[tuple[Slice, Slice]]:
    """The slices of text and source from the blocks of each row, all tokenised at once."""
    blocks, ends = column.flatten(), np.cumsum([0, *column.value_lengths().to_pylist()])
    side, block, first_byte, total = (blocks.field(c).to_numpy(zero_copy_only=False) for c in ("side", "block", "first_byte", "total"))
    order = np.lexsort((block, side, np.repeat(np.arange(len(ends) - 1), np.diff(ends))))
    data, offsets = text_buffer(blocks.field("raw").take(pa.array(order)))
    data = LOWER[data]
    low, high, ranges = words(data, offsets)
    hashes = word_hashes(data, low, high)
    shift = np.repeat(first_byte[order] - offsets[:-1], np.diff(ranges))
    low, high, out = low + shift, high + shift, []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        parted_at = a + int(np.searchsorted(side[order[a:b]], 1))
        pair = []
        for x, y in ((a, parted_at), (parted_at, b)):
            words_of = slice(int(ranges[x]), int(ranges[y]))
            pair.append(Slice(hashes[words_of], low[words_of], high[words_of], int(block[order[x]]) * BLOCK, int(total[order[x]])))
        out.append((pair[0], pair[1]))
    return out


def gap_columns(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A best alignment (longest common subsequence) of two short runs: places in either, -1 opposite nothing."""
    if len(x) == len(y):
        return np.arange(len(x)), np.arange(len(y))
    best = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i, w in enumerate(x, 1):
        best[i, 1:] = np.maximum.accumulate(np.maximum(best[i - 1, 1:], best[i - 1, :-1] + (y == w)))
    i, j, out = len(x), len(y), []
    while i or j:
        if i and j and (x[i - 1] == y[j - 1] or best[i - 1, j - 1] == best[i, j]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and best[i - 1, j] == best[i, j]:
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    at = np.array(out[::-1]).reshape(-1, 2)
    return at[:, 0], at[:, 1]


def _diagonal(x: np.ndarray, y: np.ndarray) -> tuple[int, bool, int]:
    """How far two runs are compared before the score drops, whether it did, and the place of the best score."""
    n = min(len(x), len(y))
    score = np.full(n + 1, APART)
    score[0] = 0
    score[1:][x[:n] == y[:n]] = 1
    score = score.cumsum()
    over = np.maximum.accumulate(score) - score > DROP
    at = int(over.argmax())
    if over[at]:
        n = at
    return n, bool(over[at]), int(score[: n + 1].argmax())


#: Words left out of text and source, the tries of extension() in their order.
LEFT_OUT = [(i, j) for d in range(1, SHIFT + 1) for i, j in ((d, 0), (0, d))]


def _beyond(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    """The best of LEFT_OUT for two runs that go on: the value of _diagonal() after it less what is left out, and its words."""
    agree = np.full((len(LEFT_OUT), max(len(x), len(y)) + 1), APART)
    agree[:, 0] = 0
    for row, (i, j) in zip(agree, LEFT_OUT, strict=True):
        n = min(len(x) - i, len(y) - j)
        if n > 0:
            row[1 : n + 1][x[i : i + n] == y[j : j + n]] = 1  # beyond the end nothing agrees, which raises no best score
    score = agree.cumsum(1)
    best = np.maximum.accumulate(score, 1)
    over = best - score > DROP
    last = np.where(over.any(1), over.argmax(1), score.shape[1] - 1)
    values = best[np.arange(len(best)), last].tolist()
    return max(((v + APART * (i + j), i, j) for v, (i, j) in zip(values, LEFT_OUT, strict=True)), key=lambda t: t[0])


def extension(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of two runs opposite each other (-1: none) as far as they agree, and whether the score dropped at last.

    Where it drops, up to SHIFT words of either run are left out if the score grows by BEYOND from there on.
    """
    at, to, pieces = 0, 0, []
    while True:
        n, dropped, best = _diagonal(x[at:], y[to:])
        step = (0, 0, 0)
        if dropped:
            step = _beyond(x[at + best :], y[to + best :])
        more = step[0] >= BEYOND
        length = best if more else n
        pieces.append((np.arange(at, at + length), np.arange(to, to + length)))
        if not more:
            return *(np.concatenate(c) for c in zip(*pieces, strict=True)), dropped
        at, to = at + length, to + length
        pieces.append((np.concatenate([np.arange(at, at + step[1]), np.full(step[2], -1)]), np.concatenate([np.full(step[1], -1), np.arange(to, to + step[2])])))
        at, to = at + step[1], to + step[2]


def aligned(a: Slice, b: Slice, runs: list[list[int]]) -> tuple[np.ndarray, np.ndarray, bool]:
    """Words of text and source opposite each other (-1: none), and whether an end has to be looked at further."""
    t, s = runs[0][:2]
    x, y, dropped = extension(a.between(a.first, t)[::-1], b.between(b.first, s)[::-1])
    x, y = np.where(x < 0, -1, t - 1 - x)[::-1], np.where(y < 0, -1, s - 1 - y)[::-1]
    open_ends = not dropped and a.first + b.first > 0 and bool((x != 0).all() and (y != 0).all())
    pieces = [(x, y)]
    for t0, s0, t1, s1 in runs:
        skip = max(0, t - t0, s - s0)  # seeds may overlap those of the run before
        if t0 + skip >= t1 + K:
            continue
        t0, s0 = t0 + skip, s0 + skip
        x, y = gap_columns(a.between(t, t0), b.between(s, s0))
        pieces.append((np.where(x < 0, -1, x + t), np.where(y < 0, -1, y + s)))
        t, s = t1 + K, s1 + K
        pieces.append((np.arange(t0, t), np.arange(s0, s)))
    x, y, dropped = extension(a.between(t, a.last), b.between(s, b.last))
    x, y = np.where(x < 0, -1, x + t), np.where(y < 0, -1, y + s)
    open_ends |= not dropped and max(x.max(initial=t - 1), t - 1) + 1 < a.total and max(y.max(initial=s - 1), s - 1) + 1 < b.total
    pieces.append((x, y))
    x, y = (np.concatenate(c) for c in zip(*pieces, strict=True))
    return x, y, open_ends


def _best(flags: np.ndarray, apart: float) -> tuple[int, int]:
    """The run with the highest score."""
    total = np.concatenate([[0.0], np.cumsum(np.where(flags, 1.0, apart))])
    end = int(np.argmax(total - np.minimum.accumulate(total)))
    return int(np.argmin(total[: end + 1])), end


def _longest(flags: np.ndarray) -> tuple[int, int]:
    """The longest run of which SIMILARITY agree."""
    total = np.concatenate([[0.0], np.cumsum(flags - SIMILARITY)])
    start = np.searchsorted(-np.minimum.accumulate(total), -total - 1e-9, "left")  # the first place no higher
    end = int(np.argmax(np.arange(len(total)) - start))
    return int(start[end]), end


def segments(same: np.ndarray) -> Iterator[tuple[int, int]]:
    """Disjoint runs of columns of which SIMILARITY agree: the best-scoring one if it does (ends are sharp then), else the longest."""
    waiting = [(0, len(same))]
    while waiting:
        low, high = waiting.pop()
        if high - low < LEAST:
            continue
        flags = same[low:high]
        for begin, end in (_best(flags, APART), _best(flags, 2 * APART), _longest(flags)):
            if end - begin >= LEAST and flags[begin:end].sum() >= SIMILARITY * (end - begin) - 1e-9:
                yield low + begin, low + end
                waiting += [(low, low + begin), (low + end, high)]
                break


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of each chain; of one whose ends could go on also a row with similarity -1, its number as start_byte and the words seen."""
    for whole in batches:
        for begin in range(0, whole.num_rows, 512):
            batch = whole.slice(begin, 512)
            rows: list[tuple] = []
            found = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source_id", "chain", "runs")), _slices(batch.column("blocks")), strict=True)
            for doc, source, number, runs, (a, b) in found:
                x, y, open_ends = aligned(a, b, runs)
                same = (x >= 0) & (y >= 0)
                same[same] = a.hashes[x[same] - a.first] == b.hashes[y[same] - b.first]
                if open_ends:
                    rows.append((doc, int(x[x >= 0].min()), int(x.max()) + 1, number, 0, source, 0, 0, 0, -1.0))
                if same.sum() < SIMILARITY * LEAST - 1e-9:
                    continue
                for low, high in segments(same):
                    agreeing = np.flatnonzero(same[low:high]) + low
                    left, right = int(agreeing[0]), int(agreeing[-1])
                    start, stop, source_start, source_stop = int(x[left]), int(x[right]) + 1, int(y[left]), int(y[right]) + 1
                    alike = len(agreeing) / max(stop - start, source_stop - source_start)
                    if stop - start >= LEAST and alike >= SIMILARITY - 1e-9:
                        rows.append((doc, start, stop, int(a.starts[start - a.first]), int(a.ends[stop - 1 - a.first]), source, source_start, source_stop, len(agreeing), alike))
            yield _table(rows, NAMES, KINDS)


def _going_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of a document whose first or last word seen no passage holds together with the next one."""
    for batch in batches:
        rows = []
        for doc, ends, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ends", "spans")), strict=True):
            held = sorted((s["start_word"], s["end_word"]) for s in spans or ())
            far = np.maximum.accumulate([y for _, y in held]) if held else ()  # how far those go that start no later
            for e in ends:
                for low, high in ((e["start_word"] - 1, e["start_word"] + 1), (e["end_word"] - 1, e["end_word"] + 1)):
                    at = bisect_right(held, (low, 1 << 60)) - 1
                    if low >= 0 and (at < 0 or far[at] < high):
                        rows.append((doc, e["source_id"], e["chain"]))
                        break
        yield _table(rows, ["doc_id", "source_id", "chain"], [pa.int64(), pa.int64(), pa.int32()])


def _align_all(chained: DataFrame, texts: DataFrame) -> DataFrame:
    """Passages of all chains. Only blocks of the texts around the chains are gathered, for one chain at a time.

    A chain whose ends still agree at the last word looked at comes again with a wider margin, until none does, unless a
    passage of the document holds that end and what follows.
    """
    ids = cut(chained.select(F.explode(F.array("doc_id", "source_id")).alias("doc_id")).distinct())
    blocks = cut(in_batches(restrict(texts, "doc_id", ids), _blocks, "id long, block int, raw binary, first_byte long, total int"))
    done, margin = None, MARGIN
    while True:
        first, last = F.col("runs")[0], F.element_at("runs", -1)

        def needed(place: int, margin: int = margin, first: Column = first, last: Column = last) -> Column:
            low = F.floor(F.greatest(first[place] - margin, F.lit(0)) / BLOCK)
            return F.transform(F.sequence(low, F.floor((last[place + 2] + K - 1 + margin) / BLOCK)), lambda b: F.struct(F.lit(place).alias("side"), F.col(("doc_id", "source_id")[place]).alias("id"), b.cast("int").alias("block")))

        wanted = chained.select("doc_id", "source_id", "chain", "runs", F.posexplode(F.concat(needed(0), needed(1))))
        wanted = wanted.select("doc_id", "source_id", "chain", F.when(F.col("pos") == 0, F.col("runs")).alias("runs"), "col.side", "col.id", "col.block")
        near = blocks if done is None else restrict(blocks, "id", cut(wanted.select("id").distinct()))
        got = wanted.join(near.hint("merge"), ["id", "block"])
        got = got.groupBy("doc_id", "source_id", "chain").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.collect_list(F.struct("side", "block", "raw", "first_byte", "total")).alias("blocks"))
        rows = cut(in_batches(got, _align, PASSAGE))
        found = rows.where("similarity >= 0")
        done = found if done is None else done.unionByName(found)
        ends = rows.where("similarity < 0").groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word", F.col("source_doc_id").alias("source_id"), F.col("start_byte").cast("int").alias("chain"))).alias("ends"))
        spans = done.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
        still = cut(in_batches(ends.join(spans, "doc_id", "left"), _going_on, "doc_id long, source_id long, chain int"))
        if still.isEmpty():
            return done
        chained, margin = cut(chained.join(still, ["doc_id", "source_id", "chain"], "left_semi")), margin * MORE


# ---------------------------------------------------------------- exact runs


def _stretches(places: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last word where a run of LEAST words may begin of which all seeds are among `places`."""
    at = np.unique(places)
    breaks = np.flatnonzero(np.diff(at) > WINDOW)
    first, last = at[np.concatenate([[0], breaks + 1])], at[np.concatenate([breaks, [len(at) - 1]])]
    # the first seed is among the first WINDOW windows of the run, the last one among the last
    low, high = np.maximum(first - (WINDOW - 1), 0), last - (LEAST - K - WINDOW + 1)
    yield from ((int(x), int(y)) for x, y in zip(low, high, strict=True) if x <= y)


RANGES = "doc_id long, low array<int>, high array<int>"
RANGE_KINDS = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]


def _uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the stretches of a text the beginnings of runs that its passages don't hold."""
    for batch in batches:
        rows = []
        for doc, at, again, spans in zip(batch.column("doc_id").to_pylist(), batch.column("at"), batch.column("again"), batch.column("spans").to_pylist(), strict=True):
            out: list[tuple[int, int]] = []
            places = np.concatenate([x.to_numpy(zero_copy_only=False) for x in (at.values, again.values.flatten())])
            for low, high in _stretches(_words_at(places)):
                covered = np.zeros(high + LEAST - low, bool)
                for span in spans or ():
                    covered[max(span["start_word"] - low, 0) : max(span["end_word"] - low, 0)] = True
                if not covered.all():
                    held = np.concatenate([[0], np.cumsum(covered)])
                    left = np.flatnonzero(held[LEAST:] - held[:-LEAST] < LEAST) + low
                    ends = np.flatnonzero(np.diff(left) > 1)
                    out += zip(left[np.concatenate([[0], ends + 1])].tolist(), left[np.concatenate([ends, [len(left) - 1]])].tolist(), strict=True)
            if out:
                rows.append((doc, [x for x, _ in out], [y for _, y in out]))
        yield _table(rows, ["doc_id", "low", "high"], RANGE_KINDS)


SEEDS = "seed long, offset int"


def rarest(places: np.ndarray, seeds: np.ndarray, counts: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
    """For each run of LEAST words that begins from low to high, of its seeds the one that stands at the fewest places, and its word in the run.

    `places` are in order. Seeds equally rare: the smaller one. Whoever has the run has that seed at that word of it.
    """
    i = j = 0
    inside: deque[int] = deque()  # rising in rarity; the first is the rarest
    for begin in range(low, high + 1):
        while j < len(places) and places[j] <= begin + LEAST - K:
            while inside and (counts[j], seeds[j]) <= (counts[inside[-1]], seeds[inside[-1]]):
                inside.pop()
            inside.append(j)
            j += 1
        while i < j and places[i] < begin:
            i += 1
        while inside and inside[0] < i:
            inside.popleft()
        if inside:
            yield int(seeds[inside[0]]), int(places[inside[0]]) - begin


def _telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rarest seeds of the runs that begin in the ranges of each text, and their places in these."""
    for batch in batches:
        out: set[tuple[int, int]] = set()
        for held, low, high in zip(batch.column("held"), batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True):
            lists = held.values.field("at")
            at = lists.flatten().to_numpy(zero_copy_only=False)
            seed, count = (np.repeat(held.values.field(c).to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy()) for c in ("seed", "n"))
            place, bare = _words_at(at), at < 0
            order = np.lexsort((~bare, place))  # of a place the seed without a number, which other texts have whatever their numbers
            order = order[np.concatenate([[True], np.diff(place[order]) > 0])]
            for x, y in zip(low, high, strict=True):
                out.update(rarest(place[order], seed[order], count[order], x, y))
        yield _table(sorted(out), ["seed", "offset"], [pa.int64(), pa.int32()])


def _begins(at: pa.ListArray, offsets: pa.ListArray) -> np.ndarray:
    """Where runs begin that have a place of a row at one of that row's offsets."""
    each = pc.list_value_length(offsets).to_numpy()
    row = np.repeat(np.arange(len(at)), pc.list_value_length(at).to_numpy())
    times = each[row]
    inside = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    offset = offsets.flatten().to_numpy()[np.repeat((np.cumsum(each) - each)[row], times) + inside]
    return np.unique(np.repeat(_words_at(at.flatten().to_numpy()), times) - offset)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the stretches of a text the beginnings of runs that hold a marked seed at one of its words in uncovered runs."""
    for batch in batches:
        rows = []
        for doc, places, marks in zip(batch.column("doc_id").to_pylist(), batch.column("places"), batch.column("marks"), strict=True):
            begins = _begins(marks.values.field("at"), marks.values.field("offsets"))
            out: list[tuple[int, int]] = []
            for low, high in _stretches(_words_at(places.values.to_numpy(zero_copy_only=False))):
                for begin in begins[np.searchsorted(begins, low) : np.searchsorted(begins, high, "right")].tolist():
                    if out and begin <= out[-1][1] + 1:
                        out[-1] = (out[-1][0], begin)
                    else:
                        out.append((begin, begin))
            if out:
                rows.append((doc, [x for x, _ in out], [y for _, y in out]))
        yield _table(rows, ["doc_id", "low", "high"], RANGE_KINDS)


RUNS = "seed long, doc_id long, at long, start_byte long, end_byte long, asks boolean"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of LEAST words that begin in the given ranges of each text: all in its uncovered ranges (asks), and of each run the first place in the batch."""
    for whole in batches:
        found: list[tuple[np.ndarray, ...]] = []
        for part in chunks(whole, "text"):
            data, offsets = text_buffer(part.column("text"))
            data = LOWER[data]
            starts, ends, ranges = words(data, offsets)
            value, _ = windows(word_hashes(data, starts, ends), ranges, LEAST)
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            for i, (low, high, own_low, own_high) in enumerate(zip(*(part.column(c).to_pylist() for c in ("low", "high", "own_low", "own_high")), strict=True)):
                last = int(ranges[i + 1] - ranges[i]) - LEAST
                at = np.unique(np.concatenate([np.arange(x, min(y, last) + 1) for x, y in zip(low, high, strict=True)]))
                asks = np.zeros(len(at), bool)
                for x, y in zip(own_low or (), own_high or (), strict=True):
                    asks |= (at >= x) & (at <= y)
                word = at + ranges[i]
                found.append((value[word].view(np.int64), np.full(len(at), ids[i]), at, starts[word] - offsets[i], ends[word + LEAST - 1] - offsets[i], asks))
        if found:
            seed, doc, at, start, end, asks = map(np.concatenate, zip(*found, strict=True))
            order = np.lexsort((at, doc, seed))
            first = order[np.concatenate([[True], np.diff(seed[order]) != 0])] if len(order) else order
            take = np.concatenate([np.flatnonzero(asks), first[~asks[first]]])
            yield pa.RecordBatch.from_arrays([pa.array(c[take]) for c in (seed, doc, at, start, end, asks)], [f.split()[0] for f in RUNS.split(", ")])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages from runs of LEAST words that begin one after the other."""
    for batch in batches:
        rows: list[tuple] = []
        for doc, source, runs in zip(batch.column("doc_id").to_pylist(), batch.column("head").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            part: list[dict] = []
            for r in [*sorted(runs, key=lambda r: r["at"]), None]:
                if part and (r is None or r["at"] != part[-1]["at"] + 1):
                    start, stop, there = part[0]["at"], part[-1]["at"] + LEAST, [x["source_at"] for x in part]
                    rows.append((doc, start, stop, part[0]["start_byte"], part[-1]["end_byte"], source, min(there), max(there) + LEAST, stop - start, 1.0))
                    part = []
                if r:
                    part.append(r)
        yield _table(rows, NAMES, KINDS)


def _exact_runs(texts: DataFrame, hits: DataFrame, passages: DataFrame) -> DataFrame | None:
    """Passages for runs of LEAST words that an earlier document has and that `passages` leave uncovered.

    All seeds of such a run are shared, and whoever has the run has all of them, the rarest too: its beginnings are looked for only
    in texts that hold the rarest seed of an uncovered run, as far before it as there and where all other seeds are those of uncovered runs. Each
    run is then matched, by all of its words, with the earliest document that has it.
    """
    later = hits.where("doc_id > head").groupBy("doc_id").agg(F.collect_list("at").alias("at"), F.collect_list("again").alias("again"))
    spans = passages.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    left = cut(in_batches(later.join(spans, "doc_id", "left"), _uncovered, RANGES))
    if left.isEmpty():
        return None
    ranges = F.transform(F.arrays_zip("low", "high"), lambda r: F.struct(r["low"].alias("low"), (r["high"] + (LEAST - K)).alias("high")))
    inside = F.filter("at", lambda at: F.exists("ranges", lambda r: F.greatest(at, -1 - at).between(r["low"], r["high"])))
    every = F.concat(F.array("at"), F.coalesce("again", F.array().cast("array<int>"))).alias("at")
    wanted = restrict(hits.select("seed", "doc_id", every, "n"), "doc_id", left.select("doc_id", ranges.alias("ranges")), "inner", sizes="ranges")
    wanted = cut(wanted.select("seed", "doc_id", inside.alias("at"), "n").where(F.size("at") > 0))
    held = cut(restrict(hits.select("seed", "doc_id", every), "seed", cut(wanted.select("seed").distinct())))
    counted = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("at", "seed", "n")).alias("held")).join(left, "doc_id")
    telling = cut(in_batches(counted, _telling, SEEDS).groupBy("seed").agg(F.collect_set("offset").alias("offsets")))  # LEAST - K + 1 at most
    marks = cut(restrict(held, "seed", telling, "inner", sizes="offsets").groupBy("doc_id").agg(F.collect_list(F.struct("at", "offsets")).alias("marks")))
    near = held.groupBy("doc_id").agg(F.flatten(F.collect_list("at")).alias("places")).join(marks, "doc_id")
    own = left.select("doc_id", F.col("low").alias("own_low"), F.col("high").alias("own_high"))
    near = cut(in_batches(near, _near, RANGES).join(own, "doc_id", "left"))
    runs = cut(in_batches(restrict(texts, "doc_id", near, "inner", sizes="low"), _runs, RUNS))
    first = runs.groupBy("seed").agg(F.min(F.struct("doc_id", "at")).alias("first")).select("seed", F.col("first.doc_id").alias("head"), F.col("first.at").alias("source_at"))
    pairs = runs.where("asks").join(first, "seed").where("doc_id > head")
    return in_batches(pairs.groupBy("doc_id", "head").agg(F.collect_list(F.struct("at", "start_byte", "end_byte", "source_at")).alias("runs")), _joined, PASSAGE)


# ---------------------------------------------------------------- the operator


def _widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the passages of a document and its source those that no other one holds."""
    for batch in batches:
        out = []
        for rows in batch.column("rows").to_pylist():
            far = -1
            for r in sorted(rows, key=lambda r: (r["start_word"], -r["end_word"], -r["similarity"], r["source_start_word"])):
                if r["end_word"] > far:  # all before start no later
                    far = r["end_word"]
                    out.append(tuple(r[c] for c in NAMES))
        yield _table(out, NAMES, KINDS)


def _extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in chunks(whole, "text"):
            starts, ends, ranges = words(*text_buffer(part.column("text")))
            _, offsets = text_buffer(part.column("text"))
            n = np.diff(ranges)
            some = np.flatnonzero(n >= LEAST)
            columns = [n[some], starts[ranges[some]] - offsets[some], ends[ranges[some + 1] - 1] - offsets[some]]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(some)), *map(pa.array, columns)], ["head", "n", "low", "high"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages of documents that an earlier document (smaller doc_id) has too, exactly or nearly.

    A row per passage and earlier document: doc_id, words [start_word, end_word) and bytes of the
    passage, source_doc_id and its words, n_agreeing words and similarity. Passages have at least
    LEAST words, of which SIMILARITY agree in the alignment.

    Equal texts form a class: its smallest doc_id stands for it, and each other member has one passage, its whole
    text, with that one. The texts that stand for a class are cut into K-word seeds, kept as syncmers; a seed's
    occurrences join with the smallest doc_id that has it, not with each other, so the matches grow with the
    input however often a passage repeats. Matches of a document and its source are chained in both orders with gap
    costs, and the chains aligned word by word, gaps and ends included, and cut to the parts that are alike. Then
    every run of LEAST words whose seeds are all shared and that no passage covers is matched by all its words with
    the earliest document that has it: so every word of a run of LEAST words that any earlier document has is in a passage.
    A passage that is only nearly the same is found with the earliest holder of at least two of its seeds. Passages that
    repeat only within one document aren't looked for.

    Null texts, texts of fewer than LEAST words and rows with a null doc_id take no part; rows that repeat a
    doc_id count as one document, of several texts with the one of least hash. Words and texts may be of any length.
    Other columns are ignored. An empty table gives no rows.
    """
    texts = one_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null"))
    keyed = cut(texts.select("doc_id", F.md5(F.encode("text", "utf-8")).alias("same")))
    classes = keyed.groupBy("same").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("tail")).where("head < tail").drop("tail")
    copies = cut(keyed.join(classes, "same").where("doc_id > head").select("doc_id", "head"))
    extents = in_batches(restrict(texts, "doc_id", cut(copies.select(F.col("head").alias("doc_id")).distinct())), _extent, "head long, n long, low long, high long")
    whole = copies.join(extents, "head").select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n").alias("end_word"), F.col("low").alias("start_byte"), F.col("high").alias("end_byte"), F.col("head").alias("source_doc_id"), F.lit(0).cast("long").alias("source_start_word"), F.col("n").alias("source_end_word"), F.col("n").alias("n_agreeing"), F.lit(1.0).alias("similarity"))
    texts = restrict(texts, "doc_id", copies.select("doc_id"), "left_anti")

    hits = _headed(texts)
    again = F.when(F.col("again").isNotNull(), F.struct("again", "source_at"))
    groups = hits.where("doc_id > head").groupBy("doc_id", "head").agg(F.collect_list("at").alias("at"), F.collect_list("source_at").alias("source_at"), F.collect_list(again).alias("again"))
    chained = cut(in_batches(groups.where((F.size("at") > 1) | (F.size("again") > 0)), _chain, CHAIN))
    passages = _align_all(chained, texts)
    more = _exact_runs(texts, hits, passages)
    rows = passages if more is None else passages.unionByName(more)
    rows = rows.groupBy("doc_id", "source_doc_id").agg(F.collect_list(F.struct(*NAMES)).alias("rows"))
    return in_batches(rows.select("rows"), _widest, PASSAGE).unionByName(whole)


def _remove(spans_column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts without their spans; the column of these becomes whether there were any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, changed = [], []
            for text, spans in zip(batch.column("text"), batch.column(spans_column).to_pylist(), strict=True):
                changed.append(bool(spans))
                if not spans:
                    texts.append(text.as_py())
                    continue
                raw, kept, at = text.as_py().encode(), [], 0
                for span in sorted(spans, key=lambda s: (s["start_byte"], s["end_byte"])):
                    kept.append(raw[at : max(at, span["start_byte"])])
                    at = max(at, span["end_byte"])
                texts.append(b"".join([*kept, raw[at:]]).decode("utf-8", "replace"))
            new = {"text": pa.array(texts, pa.string()), spans_column: pa.array(changed)}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(batch.schema.names)], batch.schema.names)

    return run


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with every passage that an earlier document has taken out of the later ones' texts.

    All rows stay, also those left without text; n_chars, if there, is counted anew for texts that changed. Of rows
    that repeat a doc_id with other texts only those change whose text was looked at. Columns keep their names, whatever these are.
    """
    spans_column, digest = free_names(docs, "spans", "digest")
    spans = cut(repeated_passages(docs).groupBy("doc_id").agg(F.collect_set(F.struct("start_byte", "end_byte")).alias(spans_column)))
    joined = restrict(docs, "doc_id", spans, "left", sizes=spans_column)
    if repeats(docs):
        known = one_text(docs.select("doc_id", "text").where("doc_id is not null and text is not null"))
        joined = joined.join(known.select("doc_id", F.md5(F.encode("text", "utf-8")).alias(digest)), "doc_id", "left")
        joined = joined.withColumn(spans_column, F.when(F.md5(F.encode("text", "utf-8")) == F.col(digest), F.col(spans_column)))
    rows = joined.select(*map(quoted, docs.columns), spans_column)
    schema = T.StructType([*docs.schema.fields, T.StructField(spans_column, T.BooleanType())])
    out = in_batches(rows, _remove(spans_column), schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans_column), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*map(quoted, docs.columns))
