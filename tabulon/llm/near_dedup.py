"""Near-duplicate groups by b-bit MinHash with band candidates, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_batches, restrict
from .graph import components
from .kernels import NEXT, chunks, mix, shingle_sets

SHINGLE = 5
BANDS, ROWS = 24, 4
LANES = BANDS * ROWS
#: Bits kept of each minimum, in signatures of LANES lanes.
BITS = 2
#: Lanes (of one bit) of the wide signature that prunes the exhaustive round.
WIDE = 4096
#: Candidates are dropped only when the estimate lies so many standard deviations under the threshold.
SIGMAS = 4.0

_rng = np.random.default_rng(61)
MULTIPLY = _rng.integers(1, 2**63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 2**63, WIDE, dtype=np.uint64)

SIGNATURE = "doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>, packed array<long>"


def minima(hashes: np.ndarray, lanes: int) -> np.ndarray:
    least = np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, (1 << 17) // lanes)
    for at in range(0, len(hashes), step):
        np.minimum(least, (MULTIPLY[:lanes, None] * hashes[None, at : at + step] + ADD[:lanes, None]).min(1), out=least)
    return least


def pack(least: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of well-mixed minima, packed into longs."""
    low = mix(least) & np.uint64((1 << bits) - 1)
    lanes = 64 // bits
    shift = (np.arange(lanes) * bits).astype(np.uint64)
    return np.bitwise_or.reduce(low.reshape(-1, lanes) << shift, axis=1).view(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = key * NEXT + least.reshape(BANDS, ROWS)[:, j]
    return mix(key).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in chunks(whole, "text"):
            n, hi, lo, bands, packed = [], [], [], [], []
            for hashes in shingle_sets(part.column("text"), SHINGLE):
                n.append(len(hashes))
                if len(hashes):
                    digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
                    a, b = np.frombuffer(digest, np.int64)
                    least = minima(hashes, LANES)
                    hi.append(int(a)), lo.append(int(b)), bands.append(band_keys(least)), packed.append(pack(least, BITS))
                else:
                    hi.append(None), lo.append(None), bands.append(None), packed.append(None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(bands, longs), pa.array(packed, longs)],
                ["doc_id", "n_shingles", "set_hi", "set_lo", "bands", "packed"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in chunks(whole, "text"):
            sets = [s.view(np.int64) for s in shingle_sets(part.column("text"), SHINGLE)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["id", "hashes"])


def _widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        wide = [pack(minima(np.asarray(s.values.to_numpy(zero_copy_only=False)).view(np.uint64), WIDE), 1) for s in part.column("hashes")]
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(wide, pa.list_(pa.int64()))], ["id", "wide"])


def differing(a: Column, b: Column, longs: int, bits: int) -> Column:
    """Lanes in which two packed signatures differ, counted by bits."""
    total = F.lit(0)
    for i in range(longs):
        x = a.getItem(i).bitwiseXOR(b.getItem(i))
        if bits == 2:
            x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        total = total + F.bit_count(x)
    return total


def most_differing(lanes: int, bits: int, similarity: float) -> int:
    """Differing lanes at which the collision-corrected estimate is still within SIGMAS of `similarity`.

    A lane agrees with probability J + (1 - J) / 2**bits, so the estimate is
    (agreeing share - 2**-bits) / (1 - 2**-bits).
    """
    chance = 2.0**-bits
    agree = similarity + (1 - similarity) * chance
    return int(np.ceil(lanes * (1 - agree) + SIGMAS * np.sqrt(lanes * agree * (1 - agree))))


def first_shared(a: Column, b: Column) -> Column:
    """The first band key that two signatures share: a pair of several common buckets comes from one only."""
    found = F.when(a.getItem(0) == b.getItem(0), a.getItem(0))
    for i in range(1, BANDS):
        found = found.when(a.getItem(i) == b.getItem(i), a.getItem(i))
    return found


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Group documents whose shingle sets reach `percent` of Jaccard similarity, with links followed.

    docs: doc_id (long) and text; other columns are ignored. A-Z count as a-z, words are split at
    ASCII white space, a set holds the distinct 5-word shingles (a shorter text: its whole word
    sequence). Returns a row per input row: doc_id, n_shingles, component_id (smallest doc_id
    reachable), kept.

    Equal sets become one node. Band keys of the MinHash minima name buckets; each bucket's
    documents are first compared with the bucket's smallest id, those left outside its component
    with a seeded pick of their bucket, and what is then still in different components with each
    other. Candidates pass a bit-count estimate set SIGMAS under the threshold and are confirmed
    by the exact intersection of full sets, so no wrong link is made; a pair at the threshold
    shares no band with a probability of about 1e-4 a pair.

    Empty or null texts have no set and are their own component. Equal rows share a component. A
    row with a null doc_id links with nothing: its component_id is null, kept is true. Empty input
    gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signs = cut(in_batches(docs, _sign, SIGNATURE))
    classes = signs.where("doc_id is not null and set_hi is not null").groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("id"))
    classes = cut(classes)
    nodes = signs.join(classes.withColumnRenamed("id", "doc_id"), ["doc_id", "set_hi", "set_lo"], "left_semi").dropDuplicates(["doc_id", "set_hi", "set_lo"])
    slots = nodes.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    heads = slots.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("tail")).where("head < tail").drop("tail")
    shared = cut(slots.join(heads, "key"))
    ids = cut(shared.select("id").distinct())
    packed = cut(restrict(nodes.select(F.col("doc_id").alias("id"), "packed", "n_shingles", "bands"), "id", ids))
    texts = restrict(docs.where("text is not null").withColumnRenamed("doc_id", "id"), "id", ids).withColumnRenamed("id", "doc_id")
    sets = cut(in_batches(texts, _sets, "id long, hashes array<long>").where(F.size("hashes") > 0))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs a < b whose full sets reach the threshold, of those whose packed signatures leave it open."""
        a = packed.select(F.col("id").alias("a"), F.col("packed").alias("pa"), F.col("n_shingles").alias("na"))
        b = packed.select(F.col("id").alias("b"), F.col("packed").alias("pb"), F.col("n_shingles").alias("nb"))
        near = pairs.join(a, "a").join(b, "b").where(differing(F.col("pa"), F.col("pb"), LANES * BITS // 64, BITS) <= most_differing(LANES, BITS, percent / 100))
        return verified(near.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b"))

    def verified(near: DataFrame) -> DataFrame:
        """Pairs whose full sets reach the threshold."""
        x, y = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        return cut(near.join(x, "a").join(y, "b").where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b").distinct())

    def pairs_of(df: DataFrame, one: str, other: str) -> DataFrame:
        return df.where(F.col(one) != F.col(other)).select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()

    def mixed(labels: DataFrame, rows: DataFrame) -> DataFrame:
        """Bucket rows of buckets that hold more than one component."""
        at = rows.select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        two = at.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("key")
        return cut(at.join(two, "key"))

    tried = cut(pairs_of(shared, "head", "id"))
    links = confirmed(tried)
    labels = components(links)
    rows = mixed(labels, shared)
    if not rows.isEmpty():
        pick = rows.select("key", F.struct(F.xxhash64("key", "id").alias("h"), "id", "component").alias("p")).groupBy("key").agg(F.min("p").alias("p"))
        second = rows.join(pick, "key").where("component <> p.component").select(F.col("p.id").alias("head"), "id")
        second = cut(pairs_of(second, "head", "id").join(tried, ["a", "b"], "left_anti"))
        more = confirmed(second)
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
            rows = mixed(labels, rows)
        tried = tried.unionByName(second)
    if not rows.isEmpty():
        wide = cut(in_batches(restrict(sets, "id", rows.select("id").distinct()), _widen, "id long, wide array<long>").dropDuplicates(["id"]))
        sized = rows.join(wide, "id").join(packed.select("id", "n_shingles", "bands"), "id")
        l, r = sized.alias("l"), sized.alias("r")  # noqa: E741
        near = l.join(
            r,
            (F.col("l.key") == F.col("r.key")) & (F.col("l.id") < F.col("r.id")) & (F.col("l.component") != F.col("r.component"))
            & (100 * F.least("l.n_shingles", "r.n_shingles") >= percent * F.greatest("l.n_shingles", "r.n_shingles"))
            & (differing(F.col("l.wide"), F.col("r.wide"), WIDE // 64, 1) <= most_differing(WIDE, 1, percent / 100))
            & (first_shared(F.col("l.bands"), F.col("r.bands")) == F.col("l.key")),
        )
        rest = near.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        more = verified(rest)  # their wide signatures have passed already
        if not more.isEmpty():
            labels = components(links.unionByName(more))
    out = signs.select("doc_id", "n_shingles", "set_hi", "set_lo").join(classes, ["set_hi", "set_lo"], "left").join(labels, "id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "id", "doc_id"))
    # a doc_id that stands on rows of several texts is one document: its rows share one component
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs, all columns, of which each group keeps its smallest doc_id.

    Rows that repeat a kept doc_id stay once. Rows with a null doc_id stay.
    """
    gone = near_duplicates(docs, percent).where(~F.col("kept")).select("doc_id").distinct()
    kept = restrict(docs, "doc_id", cut(gone), "left_anti")
    known = kept.where("doc_id is not null").dropDuplicates(["doc_id"]) if _repeats(docs) else kept.where("doc_id is not null")
    return known.unionByName(kept.where("doc_id is null"))


def _repeats(docs: DataFrame) -> bool:
    """Does a doc_id stand on more than one row?"""
    return not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
