"""Best-fit packing of tokenised documents by bin completion."""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_names, in_batches, quoted, ranked, rows_of

LENGTH = 2048
END = 0


# ---------------------------------------------------------------- tokens


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_encoders: dict[str, Callable[[str], np.ndarray]] = {}


def encoder(vocabulary: str) -> Callable[[str], np.ndarray]:
    """Ids of a text under the byte-level BPE of a tokenizers JSON file, as tokenizers gives them without special tokens added.

    The file's own vocabulary and pattern run on tiktoken's core, which gives the ids that tokenizers
    gives (tests hold them together) at six times the speed. The file's added tokens are found in the text first, as
    tokenizers does, and stand for themselves.
    """
    if vocabulary not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        added = {x["content"]: x["id"] for x in model.get("added_tokens", ())}
        if any(x.get(flag) for x in model.get("added_tokens", ()) for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take in what stands around them aren't handled")
        ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}
        core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

        def encode(text: str) -> np.ndarray:
            if split is None or not any(token in text for token in added):
                return np.array(core.encode_ordinary(text), np.uint32)
            ids: list[int] = []
            for part in split.split(text):
                ids += [added[part]] if part in added else core.encode_ordinary(part)
            return np.array(ids, np.uint32)

        _encoders[vocabulary] = encode
    return _encoders[vocabulary]


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _tokenise(vocabulary: str, length: int, keep_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * keep_ids]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            texts, held = batch.column("text"), 0
            for i, doc in enumerate(batch.column("doc_id").cast(pa.int64()).to_pylist()):
                ids = np.append(encode(texts[i].as_py() or ""), np.uint32(END)).astype("<u4")
                first = len(ids) % length or length
                for piece, at in enumerate([0, *range(first, len(ids), length)]):
                    part = ids[at : first if at == 0 else at + length]
                    for out, x in zip(rows, (doc, piece, at, len(part), zlib.crc32(part), part), strict=False):
                        out.append(x)
                    held += len(part)
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names)
                    rows, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names)

    return run


def tokenised_pieces(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """A row per piece of each document: doc_id, piece, start, length, ids_crc32, and on request the ids.

    A document is the ids of its text and an end id 0 (a null text: the end id alone). Only longer
    ones are cut; the first piece takes what is left over, so all later pieces are full.
    """
    run = _tokenise(vocabulary or default_vocabulary(), length, keep_ids)
    return in_batches(docs.select("doc_id", "text"), run, PIECE + ", ids array<int>" * keep_ids)


# ---------------------------------------------------------------- bin completion


def lower_bound(counts: np.ndarray, room: int) -> int:
    """Bins at least needed: by volume, and by large items with what can't join them."""
    sizes = np.arange(len(counts))
    best = -(-int((counts * sizes).sum()) // room)
    for small in {0, *(int(x) for x in np.flatnonzero(counts) if 2 * x <= room)}:
        alone = counts[sizes > room - small].sum()
        half = (sizes > room // 2) & (sizes <= room - small)
        rest = (sizes >= small) & (sizes <= room // 2)
        free = int(counts[half].sum()) * room - int((counts[half] * sizes[half]).sum())
        over = int((counts[rest] * sizes[rest]).sum()) - free
        best = max(best, int(alone + counts[half].sum()) + max(0, -(-over // room)))
    return best


def dominated(small: tuple[int, ...], by: tuple[int, ...]) -> bool:
    """Can the items of `small` be dealt into the items of `by` as bins?"""
    bins = list(by)

    def deal(i: int) -> bool:
        if i == len(small):
            return True
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] >= small[i]:
                bins[j] -= small[i]
                done = deal(i + 1)
                bins[j] += small[i]
                if done:
                    return True
        return False

    return small != by and sum(small) <= sum(by) and deal(0)


def fillings(counts: np.ndarray, room: int, waste: int, most: float = 6, calls: float = 400) -> tuple[list[tuple[int, ...]], bool]:
    """Undominated multisets of available sizes that fill `room` with at most `waste` left, least waste first.

    The first leaf of the search takes the largest size that fits each time: the best-fit filling.
    One exact size dominates every other filling. `most` and `calls` bound what a node enumerates;
    the best-fit filling is always among it. The second value tells whether the bounds cut nothing off.
    """
    if room == 0:
        return [()], True
    if room < len(counts) and counts[room]:
        return [(room,)], True
    have = np.flatnonzero(counts[: room + 1])
    have = have[have > 0]
    if not len(have):
        return ([()] if room <= waste else []), True
    found: dict[tuple[int, ...], int] = {}
    # exact pairs at once: sizes a >= b with a + b = room
    pair = have[(counts[room - have] > 0) & (2 * have >= room)]
    for a in pair[::-1]:
        if 2 * a != room or counts[a] > 1:
            found[int(a), int(room - a)] = 0
            if len(found) >= most:
                break
    below = np.zeros(room + 1, np.int64)
    below[have] = have
    below = np.maximum.accumulate(below)
    left = counts
    used: dict[int, int] = {}
    spent, whole = 0, len(found) < most

    def fits(space: int, at_most: int) -> int:
        s = int(below[min(space, at_most)])
        while s and left[s] <= used.get(s, 0):
            s = int(below[s - 1])
        return s

    def search(space: int, at_most: int, chosen: tuple[int, ...]) -> None:
        nonlocal spent, whole
        spent += 1
        s = fits(space, at_most)
        if not s:
            if not fits(space, space) and space <= waste:
                found.setdefault(chosen, space)
            return
        while s:
            used[s] = used.get(s, 0) + 1
            search(space - s, s, (*chosen, s))
            used[s] -= 1
            if len(found) >= most or spent > calls:
                whole = False
                return
            s = fits(space, s - 1)

    if len(found) < most:
        search(room, room, ())
    kept: list[tuple[int, ...]] = []
    for f in sorted(found, key=lambda f: (found[f], [-x for x in f])):
        if not any(dominated(f, k) for k in kept):
            kept.append(f)
    return kept, whole


def greedy(counts: np.ndarray, room: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on the counts of sizes: patterns and how often each is used."""
    counts, out = counts.copy(), []
    while len(have := np.flatnonzero(counts)):
        pattern, space = [], room
        used: dict[int, int] = {}
        while space:
            fit = have[have <= space]
            s = next((int(x) for x in fit[::-1] if counts[x] > used.get(int(x), 0)), 0)
            if not s:
                break
            used[s] = used.get(s, 0) + 1
            pattern.append(s)
            space -= s
        times = min(int(counts[s]) // n for s, n in used.items())
        for s, n in used.items():
            counts[s] -= n * times
        out.append((tuple(pattern), times))
    return out


@dataclass(frozen=True)
class Packing:
    """patterns: sizes of a bin, largest first, and how often; bins; bound: bins at least needed; proven: no packing has fewer."""

    patterns: list[tuple[tuple[int, ...], int]]
    bins: int
    bound: int
    proven: bool


def bin_completion(counts: np.ndarray, room: int, nodes: float = 6_000, most: float = 6, calls: float = 400) -> Packing:
    """Pack counts[s] items of each size s into bins of `room`.

    Branch and bound: around the largest item left, the undominated fillings are tried in order of
    waste; equal bins are taken as often as the counts allow in one step (with unbounded `nodes` one by one). A branch ends when
    its waste would need as many bins as the incumbent. The best-fit packing is the first incumbent;
    the search ends at the lower bound, when everything is tried, or after `nodes` steps, and returns the incumbent with the
    bound and whether it is proven to be the least. Work and memory depend on `room` and `nodes`, not on how
    many items there are. exact_packing() lifts all bounds of the search.
    """
    counts = counts.astype(np.int64).copy()
    counts[0] = 0
    if not counts.any():
        return Packing([], 0, 0, True)
    best = greedy(counts, room)
    bins = sum(m for _, m in best)
    least, total = lower_bound(counts, room), int((counts * np.arange(len(counts))).sum())
    path: list[tuple[tuple[int, ...], int]] = []
    waste, whole, exact = 0, True, math.isinf(nodes)

    def choices() -> Iterator[tuple[int, ...]]:
        nonlocal whole
        top = int(np.flatnonzero(counts)[-1])
        counts[top] -= 1
        allowed = (bins - 1) * room - total - waste
        found, complete = fillings(counts, room - top, allowed, most, calls) if allowed >= 0 else ([], True)
        whole &= complete
        counts[top] += 1
        return iter([(top, *f) for f in found])

    stack = [choices()] if bins > least else []
    while stack and nodes > 0 and bins > least:
        nodes -= 1
        pattern = next(stack[-1], None)
        if pattern is None:
            stack.pop()
            if path:
                undone, times = path.pop()
                sizes, often = np.unique(undone, return_counts=True)
                counts[sizes] += often * times
                waste -= (room - sum(undone)) * times
            continue
        sizes, often = np.unique(pattern, return_counts=True)
        times = 1 if exact else int((counts[sizes] // often).min())
        loss = room - sum(pattern)
        allowed = (bins - 1) * room - total - waste
        if loss > allowed:
            continue
        if loss:
            times = max(1, min(times, allowed // loss))
        counts[sizes] -= often * times
        waste += loss * times
        path.append((pattern, times))
        if not counts.any():
            used = sum(m for _, m in path)
            if used < bins:
                best, bins = list(path), used
            stack.append(iter(()))
        else:
            stack.append(choices())
    return Packing(best, bins, least, bins <= least or (exact and whole))


def exact_packing(counts: np.ndarray, room: int) -> Packing:
    """bin_completion without bounds on nodes and fillings: proven to be least, however long it takes."""
    return bin_completion(counts, room, nodes=math.inf, most=math.inf, calls=math.inf)


# ---------------------------------------------------------------- assignment


def _deal(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Slots by size: key (size, first rank), and for it the pattern's first sequence, copies' items and offset."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for pattern, times in patterns:
        sizes, first, often = np.unique(np.array(pattern), return_index=True, return_counts=True)
        place = np.cumsum([0, *pattern])
        for s, i, n in zip(sizes.tolist(), first.tolist(), often.tolist(), strict=True):
            rows.append((s, taken.get(s, 0), base, n, int(place[i])))
            taken[s] = taken.get(s, 0) + n * times
        base += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else tuple(np.zeros(0, np.int64) for _ in range(5))


def _place(slots: tuple[np.ndarray, ...], rank_column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    size, first, base, often, offset = slots
    key = (size << 44) + first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", rank_column))
            at = np.searchsorted(key, (length << 44) + rank - 1, "right") - 1
            copy, item = np.divmod(rank - 1 - first[at], often[at])
            kept = [c for c in batch.schema.names if c != rank_column]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(base[at] + copy), pa.array(offset[at] + item * length)], [*kept, "sequence_id", "offset"])

    return run


def packed(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pack pieces (tokenised_pieces: 1 to `length` tokens each) into sequences: pieces plus sequence_id and offset.

    Only the counts of pieces by length (at most `length` numbers) go to the driver, whatever the
    input; bin completion turns them into patterns, and each piece finds its place by its rank
    among those of its length. `pieces` is read several times, so hand in a table that is cut from its lineage.
    Null doc_ids, repeated rows and repeated doc_ids are packed like others; no piece, no rows.
    """
    counts = np.zeros(length + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most `length` rows
        counts[row["length"]] = row["count"]
    slots = _deal(bin_completion(counts, length).patterns)
    keep = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    rank = free_names(pieces, "rank")[0]
    ties = [F.col("row").getField(c) for c in ("doc_id", "piece", "start", "ids_crc32")]
    dealt = ranked(rows_of(pieces.select(*map(quoted, keep)), F.col("length").alias("key")), int(counts.sum()), ties, 29)
    dealt = dealt.select(*(F.col("row").getField(c).alias(c) for c in keep), F.col("rank").alias(rank))
    schema = T.StructType([*pieces.select(*map(quoted, keep)).schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return in_batches(dealt, _place(slots, rank), schema)


def pack_documents(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Tokenise and pack docs (doc_id, text; other columns ignored): a row per piece with its place.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids on request. Null
    texts count as empty (their end id alone), empty tables give no rows, repeated rows are packed each.
    """
    return packed(cut(tokenised_pieces(docs, length, vocabulary, keep_ids)), length)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids, from pack_documents(keep_ids=True)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
