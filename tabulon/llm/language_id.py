"""Language identification by prediction by partial matching with frozen byte context trees."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, in_batches
from .kernels import chunks, text_buffer

#: Bytes of context of the deepest tree level.
ORDER = 3
#: Bytes of text per language that the trees are grown from, in hash order.
SAMPLE_BYTES = 1_500_000
SAMPLE_ROWS = 600
SAMPLE_TEXT = 250_000
MOST_LANGUAGES = 200
UNKNOWN = "und"


class Lookup:
    """Rows of costs by integer key: open addressing in a fixed table, misses give row 0."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.bits = max(10, int(len(keys) * 4 - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.at = np.zeros(1 << self.bits, np.int32)
        self.rows = np.concatenate([np.full((1, rows.shape[1]), np.nan, np.float32), rows.astype(np.float32)])
        self.probes = 0
        left, place = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[place] == -1
            self.keys[place[free]] = keys[left[free]]  # of several for one slot the last stays
            mine = self.keys[place] == keys[left]
            self.at[place[mine]] = left[mine] + 1
            left, place = left[~mine], (place[~mine] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        place = self._slot(keys)
        here = self.keys[place]
        out = np.where(here == keys, self.at[place], 0)
        left = np.flatnonzero((here != keys) & (here != -1))
        for _ in range(self.probes - 1):
            if not len(left):
                break
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)
            here = self.keys[place[left]]
            hit = here == keys[left]
            out[left[hit]] = self.at[place[left[hit]]]
            left = left[~hit & (here != -1)]
        return out


@dataclass(frozen=True)
class LanguageModel:
    """Bits of a byte after its context, by language, for every order.

    seen[k]: keys of k + 1 bytes (k of context) known in any language; cost[k]: their bits by
    language; contexts[k], escape[k]: known contexts of k bytes and the bits of an escape from them.
    """

    languages: tuple[str, ...]
    seen: tuple[np.ndarray, ...]
    cost: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]
    escape: tuple[np.ndarray, ...]


def _grams(data: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """Each byte with the k before it as one integer; before a text's start stand zero bytes."""
    out = data.astype(np.int64)
    first = np.repeat(offsets[:-1], np.diff(offsets))
    inside = np.arange(len(data)) - first
    for j in range(1, k + 1):
        before = np.zeros(len(data), np.int64)
        before[j:] = data[:-j] if j < len(data) else before[j:]
        out |= np.where(inside >= j, before, 0) << (8 * j)
    return out


def grow(samples: dict[str, list[bytes]]) -> LanguageModel:
    """Context trees of all orders up to ORDER from each language's texts, frozen.

    Escapes follow method C: after a context seen n times with d distinct bytes, a byte seen c times
    costs -log2(c / (n + d)), an escape -log2(d / (n + d)); a context never seen escapes for nothing.
    Below order 0 all 256 bytes are alike. Nothing is excluded after an escape.
    """
    languages = tuple(sorted(samples))
    counted: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for k in range(ORDER + 1):
        level = []
        for name in languages:
            data = np.frombuffer(b"".join(samples[name]), np.uint8)
            offsets = np.cumsum([0, *map(len, samples[name])])
            level.append(np.unique(_grams(data, offsets, k), return_counts=True))
        counted.append(level)
    seen, cost, contexts, escape = [], [], [], []
    for k in range(ORDER + 1):
        known = np.unique(np.concatenate([g for g, _ in counted[k]]))
        around = np.unique(known >> 8)
        bits = np.empty((len(known), len(languages)))
        out = np.zeros((len(around), len(languages)))
        for i, (grams, counts) in enumerate(counted[k]):
            slot = np.searchsorted(around, grams >> 8)
            total = np.bincount(slot, counts, len(around))
            kinds = np.bincount(slot, minlength=len(around))
            has = total > 0
            out[has, i] = -np.log2(kinds[has] / (total[has] + kinds[has]))
            # lower orders price what this language hasn't seen here
            if k == 0:
                below = np.full(len(known), 8.0)
            else:
                lower = known & ((1 << (8 * k)) - 1)
                below = cost[k - 1][np.searchsorted(seen[k - 1], lower), i]
            of = np.searchsorted(around, known >> 8)
            bits[:, i] = out[of, i] + below
            mine = np.searchsorted(known, grams)
            bits[mine, i] = -np.log2(counts / (total[slot] + kinds[slot]))
        seen.append(known)
        cost.append(bits)
        contexts.append(around)
        escape.append(out)
    return LanguageModel(languages, tuple(seen), tuple(cost), tuple(contexts), tuple(escape))


class Coder:
    """Code lengths of texts under a model."""

    def __init__(self, model: LanguageModel):
        self.languages = model.languages
        self.cost = [Lookup(k, c) for k, c in zip(model.seen, model.cost, strict=True)]
        self.escape = [Lookup(k, c) for k, c in zip(model.contexts, model.escape, strict=True)]

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Exact code length in bits of each text (rows) by language (columns), end not coded."""
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        if not len(data) or not self.languages:
            return total
        grams = _grams(data, offsets, ORDER)
        at = self.cost[ORDER].find(grams)
        bits = self.cost[ORDER].rows[at]
        missing = np.flatnonzero(at == 0)
        if len(missing):
            bits[missing] = self._lower(grams[missing], ORDER)
        some = np.diff(offsets) > 0
        for i in range(len(self.languages)):
            total[some, i] = np.add.reduceat(bits[:, i], offsets[:-1][some], dtype=np.float64)
        return total

    def _lower(self, grams: np.ndarray, k: int) -> np.ndarray:
        """Costs of grams that no language has at order k."""
        out = self.escape[k].rows[self.escape[k].find(grams >> 8)]
        out = np.where(np.isnan(out), 0, out)
        if k == 0:
            return out + 8
        shorter = grams & ((1 << (8 * k)) - 1)
        at = self.cost[k - 1].find(shorter)
        rest = self.cost[k - 1].rows[at]
        missing = np.flatnonzero(at == 0)
        if len(missing):
            rest[missing] = self._lower(shorter[missing], k - 1)
        return out + rest


def fit(docs: DataFrame) -> LanguageModel:
    """Trees from about SAMPLE_ROWS texts of each language, in hash order until SAMPLE_BYTES are reached.

    Of a longer text the first SAMPLE_TEXT characters count, and every language has at least one text, so the driver never holds
    more than SAMPLE_BYTES and one text for a language, of MOST_LANGUAGES at most (more are an error). Rows with null or empty text,
    null lang, and held-out rows aren't looked at; other columns neither. No rows: nothing is learned.
    """
    rows = docs.select("doc_id", "text", "lang", F.xxhash64(F.lit(9), "doc_id").alias("order")).where(~held_out()).where("text is not null and lang is not null and length(text) > 0")
    sums = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b"), F.min("order").alias("first")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(sums) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sums:
        return LanguageModel((), (), (), (), ())
    wide = 1 << 40
    share = F.lit(0)
    for r in sums:
        share = F.when(F.col("lang") == r["lang"], F.lit(math.ceil(min(1.0, SAMPLE_ROWS / r["n"], SAMPLE_BYTES / r["b"]) * wide))).otherwise(share)
    first = F.lit(False)
    for r in sums:  # of every language the text of least hash, so that none is left out
        first = first | ((F.col("lang") == r["lang"]) & (F.col("order") == F.lit(r["first"])))
    order = Window.partitionBy("lang").orderBy("order", "doc_id", "text")
    chosen = rows.where((F.pmod("order", F.lit(wide)) < share) | first).select("lang", "order", "doc_id", F.substring("text", 1, SAMPLE_TEXT).alias("text"))
    before = F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    chosen = chosen.withColumn("number", F.row_number().over(order)).withColumn("before", F.coalesce(before, F.lit(0)))
    samples: dict[str, list[bytes]] = {}
    for r in chosen.where((F.col("before") < SAMPLE_BYTES) & (F.col("number") <= 2 * SAMPLE_ROWS)).orderBy("lang", "number").collect():
        samples.setdefault(r["lang"], []).append(r["text"].encode())
    return grow(samples)


def _predict(model: LanguageModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(model)
        names = np.array([*model.languages, UNKNOWN], object)
        for whole in batches:
            for part in chunks(whole, "text", 1 << 20):
                data, offsets = text_buffer(part.column("text"))
                bits = coder.bits(data, offsets)
                letters = part.column("letters").to_numpy(zero_copy_only=False).astype(bool)
                best, score = np.full(len(letters), -1), np.zeros(len(letters))
                if len(model.languages):
                    best = bits.argmin(1)
                    # share of the winner when code lengths of about 32 bytes of the text are compared
                    scale = 32 / np.maximum(np.diff(offsets), 32)
                    score = 1 / np.exp2(-(bits - bits.min(1, keepdims=True)) * scale[:, None]).sum(1)
                best, score = np.where(letters, best, -1), np.where(letters, score, 0.0)
                kept = [c for c in part.schema.names if c not in ("text", "letters")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(names[best], pa.string()), pa.array(score)], [*kept, "lang_pred", "score"])

    return run


def predicted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred (the language with the shortest exact code for the whole text) and score.

    lang_pred is `und` with score 0 for null texts, texts without a letter, and where nothing could be
    learned. Ties go to the language first in order. A row per input row; only doc_id and text are looked at.
    """
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return in_batches(rows, _predict(model), f"doc_id {kind}, lang_pred string, score double")
