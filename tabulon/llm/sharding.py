"""Sharding by proportional stratified interleaving, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, key_of, quoted, ranked, rows_of


def interleaved_shards(docs: DataFrame, n_shards: int = 40, source: str = "source", tie: tuple[str, ...] = ("doc_id",), seed: int = 17) -> DataFrame:
    """Cut docs into shards that all have the mixture of the whole: docs plus shard and slot.

    The rows of each source are put in a seeded pseudo-random order; row r of n stands at
    (r - 1/2) / n of its source; all rows are sorted by that place and cut into `n_shards` runs
    whose counts are at most one apart. slot is the place in the shard, gapless from 0.

    Neither order gathers a source or all rows in one task: both are dealt into about sqrt(rows)
    buckets whose counts give the offsets (see common.ranked).

    Nulls in any column are values like others (a null source is a source of its own); rows equal
    in all `tie` columns and in source take neighbouring places in either order; columns named
    shard or slot are replaced, others keep their names and values, whatever these are; an empty table
    gives an empty result; with fewer rows than shards some shards are empty. Law: row counts at most one apart.
    """
    rows = docs.count()
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    ties = [F.col(f"tie{i}") for i in range(len(tie))]
    placed = ranked(rows_of(docs.select(*map(quoted, kept)), key_of(source).alias("key"), *(quoted(c).alias(f"tie{i}") for i, c in enumerate(tie))), rows, ties, seed)
    n = buckets_for(rows)
    placed = placed.withColumn("share", (F.col("rank") - 0.5) / F.col("total"))
    placed = placed.withColumn("run", F.least(F.floor(F.col("share") * n), F.lit(n - 1)))
    upto = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("run").agg(F.count(F.lit(1)).alias("n")).select("run", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("run").orderBy("share", "key", "hash", *ties)
    placed = placed.withColumn("place", F.row_number().over(inside)).join(offsets, "run")
    placed = placed.withColumn("at", F.col("earlier") + F.col("place") - 1)
    placed = placed.withColumn("shard", F.expr(f"cast((at * {n_shards}) div {max(rows, 1)} as int)"))
    placed = placed.withColumn("slot", F.expr(f"at - (cast(shard as bigint) * {max(rows, 1)} + {n_shards - 1}) div {n_shards}"))
    return placed.select(*(F.col("row").getField(c).alias(c) for c in kept), "shard", "slot")


def write_shards(sharded: DataFrame, path: str, n_shards: int = 40) -> None:
    """Write a folder for each shard, rows in slot order."""
    sharded.repartitionByRange(n_shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digest(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """A row per document: doc_id, size (UTF-8 bytes plus 16), text_crc32, law, shard, slot, grown_shard.

    A null text has size 16 and a null text_crc32. The text itself isn't shuffled.
    """
    narrow = docs.select(
        "doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.encode("text", "utf-8")).alias("text_crc32")
    )
    out = interleaved_shards(narrow, n_shards, tie=("doc_id", "text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
