"""Approximate nearest neighbours by inner product: probed lists scanned with adaptive dimension sampling."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Vectors that the lists' centres are fitted on at most, in hash order.
SAMPLE = 20_000
MOST_LISTS = 4_096
#: Share of the lists that a query probes, and the least number.
PROBED, LEAST_PROBED = 0.6, 8
#: Vectors and queries that one task holds together.
BLOCK = 2_048
QUERIES = 4_096
#: Dimensions of a column block, and the factor of the test that abandons a candidate after it.
COLUMNS = 16
EPSILON = 2.1
#: Share of candidates left down to which a column block is read for all of them.
DENSE = 0.05
#: Different numbers of dimensions that may occur.
MOST_SIZES = 32
#: Sampled vectors whose scores bound each query's k-th best from below.
BOUNDING = 4_096


def usable(column: str = "embedding") -> Column:
    """Not null, not zero, and every component a finite number."""
    ok = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(column).isNotNull() & ok & F.exists(column, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(flat), -1)


def centres(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """k-means centres of a sample (seeded; a centre that loses all its vectors moves to a random one)."""
    rng = np.random.default_rng(12)
    at = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        nearest = _nearest(sample, at)
        count = np.bincount(nearest, minlength=lists)
        total = np.zeros_like(at)
        np.add.at(total, nearest, sample)
        at = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], sample[rng.integers(len(sample), size=lists)])
    return at


def _nearest(vectors: np.ndarray, at: np.ndarray) -> np.ndarray:
    half = (at * at).sum(1) / 2
    return np.concatenate([(vectors[i : i + 4096] @ at.T - half).argmax(1) for i in range(0, len(vectors), 4096)]) if len(vectors) else np.zeros(0, int)


def rotation(dimensions: int) -> np.ndarray:
    """A seeded random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(3).normal(size=(dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def scan(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k best of one block for each query: query ids, vector ids and exact scores, some queries at a time.

    bounds: a score that k vectors besides the query reach, for each query. Vectors and queries are
    rotated and read in column blocks. After d of D columns a candidate is abandoned if its partial
    squared distance, scaled by D / d, exceeds (1 + EPSILON / sqrt(d))**2 times the squared distance that a score at the
    bound would mean. While most candidates are left, a block is one matrix product; then only those
    left are read. They are scored on the original vectors in double precision.
    """
    size = vectors.shape[1]
    turn = rotation(size)
    turned, asked = vectors @ turn, queries @ turn
    edges = [*range(0, size, COLUMNS), size]
    norms = (vectors * vectors).sum(1)
    block_norms = np.stack([(turned[:, a:b] ** 2).sum(1) for a, b in zip(edges, edges[1:], strict=False)])
    step = max(1, (1 << 20) // max(1, len(vectors)))
    for low in range(0, len(queries), step):
        q, t, own, floor = queries[low : low + step], asked[low : low + step], query_ids[low : low + step], bounds[low : low + step]
        most = np.maximum((q * q).sum(1)[:, None] + norms - 2 * floor[:, None], 0) + 1e-9
        part, alive = np.zeros(most.shape), own[:, None] != ids
        pairs = None
        for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            slack = (1 + EPSILON / math.sqrt(b)) ** 2 * b / size if b < size else 1.0
            if pairs is None and alive.mean() > DENSE:  # most are left: one product for all
                part += block_norms[n] + (t[:, a:b] ** 2).sum(1)[:, None] - 2 * (t[:, a:b] @ turned[:, a:b].T)
                alive &= part <= slack * most
            else:
                if pairs is None:
                    pairs = np.nonzero(alive)
                    part, most = part[pairs], most[pairs]
                i, j = pairs
                more = turned[j, a:b] - t[i, a:b]
                part = part + np.einsum("pd,pd->p", more, more)
                stay = part <= slack * most
                pairs, part, most = (i[stay], j[stay]), part[stay], most[stay]
        i, j = np.nonzero(alive) if pairs is None else pairs
        score = (vectors[j] * q[i]).sum(1)
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        begin = np.searchsorted(i, i)
        best = np.arange(len(i)) - begin < k
        yield own[i[best]], ids[j[best]], score[best]


def _assign(at: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = _nearest(_matrix(batch.column("embedding")), at) if batch.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(lists, pa.int32())], ["vec_id", "embedding", "list"])

    return run


def _probe(at: np.ndarray, probed: int, sample: np.ndarray, sample_ids: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                vectors, ids = _matrix(batch.column("embedding")), batch.column("vec_id").to_numpy()
                score = vectors @ sample.T
                score[ids[:, None] == sample_ids] = -np.inf
                bound = np.partition(score, -k, axis=1)[:, -k] - 1e-9 if score.shape[1] > k else np.full(len(ids), -np.inf)
                near = vectors @ at.T
                lists = np.argpartition(-near, probed - 1, axis=1)[:, :probed] if probed < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(near), 1))
                row = np.repeat(np.arange(len(lists)), lists.shape[1])
                part = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("embedding"), pa.array(bound[row]), pa.array(lists.ravel(), pa.int32())], ["query_id", "query", "bound", "list"])

    return run


def _known(sample: np.ndarray, sample_ids: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each query's k best of the bounding sample: the vectors that reach its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            ids = batch.column("vec_id").to_numpy()
            for own, q in zip(ids, _matrix(batch.column("embedding")) if len(ids) else (), strict=True):
                score = (sample * q).sum(1)
                score[sample_ids == own] = -np.inf
                best = np.argpartition(-score, k - 1)[:k] if len(score) > k else np.arange(len(score))
                best = best[np.isfinite(score[best])]
                rows.append((np.full(len(best), own), sample_ids[best], score[best]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], ["query_id", "vec_id", "score"])

    return run


def _search(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if block.num_rows and asked.num_rows:
            ids, query_ids = (t.column(c).to_numpy() for t, c in ((block, "vec_id"), (asked, "query_id")))
            out.extend(scan(_matrix(block.column("embedding")), ids, _matrix(asked.column("query")), query_ids, asked.column("bound").to_numpy(), k))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return run


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest by inner product of each vector whose vec_id `every` divides: query_id, rank, vec_id, score.

    Candidates are all other ids. Every vector is indexed in the list of its nearest centre; the centres
    are fitted on at most SAMPLE vectors, their number grows with the square root of the vectors up to MOST_LISTS. A query
    scans the PROBED share of lists with the best centres. Lists are dealt by hash into blocks of about BLOCK vectors, and a
    block meets at most about QUERIES queries at a time, so no list, however common its vector, meets in one task.
    Candidates that can't reach the k-th best of a bounded sample are abandoned early; that sample's best are
    answers too, so every query has k. Scores are exact, in double precision on the given vectors; ties go to the smaller vec_id.

    Null, zero and non-finite vectors and null ids take no part. Vectors of another number of dimensions have no inner product with a
    query, so each number is searched by itself (MOST_SIZES at most, more are an error). Equal rows count once; an id that stands on several vectors is a candidate with each, as a query with its
    least. Fewer candidates than k: all. No vectors: no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable())
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(MOST_SIZES + 1).collect()
    if len(sizes) > MOST_SIZES:
        raise ValueError(f"more than {MOST_SIZES} numbers of dimensions")
    found = [_nearest_of(rows.where(F.size("embedding") == r["d"]), r["count"], every, k) for r in sizes]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _nearest_of(rows: DataFrame, n: int, every: int, k: int) -> DataFrame:
    """nearest() for n vectors of one number of dimensions."""
    lists = max(1, min(MOST_LISTS, math.isqrt(n) // 2))
    hashed = rows.withColumn("__h", F.xxhash64(F.lit(2), "vec_id"))
    if n > SAMPLE:
        hashed = hashed.where(F.pmod("__h", F.lit(1 << 40)) < int(1.2 * SAMPLE / n * (1 << 40)))
    taken = hashed.orderBy("__h", "vec_id").select("vec_id", "embedding").limit(SAMPLE).collect()
    sample, sample_ids = np.array([r["embedding"] for r in taken], float), np.array([r["vec_id"] for r in taken])
    at = centres(sample, min(lists, len(sample)))
    kind = dict(rows.dtypes)["embedding"]
    indexed = cut(rows.mapInArrow(_assign(at), f"vec_id long, embedding {kind}, list int"))
    asked = indexed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    probed = min(len(at), max(LEAST_PROBED, math.ceil(PROBED * len(at))))
    known = asked.mapInArrow(_known(sample[:BOUNDING], sample_ids[:BOUNDING], k), "query_id long, vec_id long, score double")
    asked = cut(asked.mapInArrow(_probe(at, probed, sample[:BOUNDING], sample_ids[:BOUNDING], k), f"query_id long, query {kind}, bound double, list int"))
    sizes = indexed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))  # at most MOST_LISTS rows
    sizes = sizes.join(asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("turns")), "list")
    sizes = F.broadcast(cut(sizes))
    data = indexed.join(sizes, "list").withColumn("block", F.expr("pmod(xxhash64(vec_id), blocks)")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    wanted = asked.join(sizes, "list").withColumn("turn", F.expr("cast(pmod(xxhash64(query_id), turns) as int)")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["list", F.col("block").cast("int").alias("block"), "turn"]
    data = data.select(*key, "vec_id", "embedding")
    wanted = wanted.select(*key, "query_id", "query", "bound")
    names = ["list", "block", "turn"]
    found = data.groupBy(*names).cogroup(wanted.groupBy(*names)).applyInArrow(_search(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.unionByName(known).withColumn("__last", F.lag("vec_id").over(order))
    found = found.where("__last is null or __last <> vec_id")  # a sampled vector that its list gave too
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
