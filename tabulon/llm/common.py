"""Shared plumbing: tables cut out of their lineage, size-checked joins and distributed ranks."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast only when a count shows at most so many narrow rows.
BROADCAST_ROWS = 400_000
#: Bytes of an Arrow batch, held by the JVM and by a Python worker for every task at once.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where none is named, one of its own in local mode (one machine, as in tests); on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tabulon-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared folder and read back.

    Lineage ends there, so a lost executor re-reads files instead of repeating the work.
    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def restrict(df: DataFrame, key: str, ids: DataFrame, how: str = "left_semi", limit: int = BROADCAST_ROWS, sizes: str | None = None) -> DataFrame:
    """Join df with ids (unique in `key`); ids is broadcast only if a count shows it is within `limit` rows.

    `sizes` names an array column of ids whose elements count instead of rows.
    """
    if sizes:
        small = (ids.agg(F.sum(F.greatest(F.size(sizes), F.lit(1)))).first()[0] or 0) <= limit
    else:
        small = ids.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(ids) if small else ids.hint("merge"), key, how)


def quoted(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, changed where df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def rows_of(df: DataFrame, *more: Column) -> DataFrame:
    """Whole rows of df as one column `row`, beside `more`: helper columns then can't clash with its names."""
    return df.select(F.struct(*map(quoted, df.columns)).alias("row"), *more)


def repeats(docs: DataFrame) -> bool:
    """Does a doc_id stand on more than one row?"""
    return not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def one_text(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with one row for each doc_id: of several texts the one of least hash."""
    if not repeats(docs):
        return docs
    digest = F.md5(F.encode("text", "utf-8"))
    least = docs.groupBy("doc_id").agg(F.min(digest).alias("digest"))
    return docs.withColumn("digest", digest).join(least, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id"]).drop("digest")


def in_batches(df: DataFrame, function: Callable, schema: object) -> DataFrame:
    """df.mapInArrow, in batches of about BATCH_BYTES at most; a longer row stands alone.

    The bound is a setting of the session, read when the plan runs: it is left as it is if the session has one of its own.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "67108864b"):  # Spark's default
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def key_of(name: str) -> Column:
    """A value as a string that is never null; null differs from every value."""
    return F.when(quoted(name).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), quoted(name).cast("string")))


def buckets_for(rows: int) -> int:
    """The square root of the rows: buckets and rows in a bucket then grow alike."""
    return max(1, math.isqrt(max(rows, 1)))


def ranked(df: DataFrame, rows: int, tie: list[Column], seed: int, weight: str | None = None) -> DataFrame:
    """Rank the rows of each `key` in a seeded pseudo-random order without gathering a key in one task.

    Rows of a key are dealt by hash into about sqrt(rows) buckets; the rank is that within the
    bucket plus the counts of the key's earlier buckets. Adds hash, rank (from 1), total (rows of
    the key) and, given `weight` (a column of whole numbers), before (weight of earlier rows)
    and sum (weight of the key). `tie` are columns that tell rows apart; rows equal in
    all of them take neighbouring ranks in either order. Names of df other than key and the weight must
    differ from the added ones and from bucket: hand in rows_of().
    """
    n = buckets_for(rows)
    df = df.withColumn("hash", F.xxhash64(F.lit(seed), *tie)).withColumn("bucket", F.pmod(F.col("hash"), F.lit(n)))
    sums = [F.count(F.lit(1)).alias("c"), F.sum(F.col(weight) if weight else F.lit(0)).alias("w")]
    key, upto = Window.partitionBy("key"), Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy("key", "bucket").agg(*sums).select(
        "key", "bucket",
        F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("c0"), F.coalesce(F.sum("w").over(upto), F.lit(0)).alias("w0"),
        F.sum("c").over(key).alias("total"), F.sum("w").over(key).alias("sum"),
    )
    inside = Window.partitionBy("key", "bucket").orderBy("hash", *tie)
    df = df.withColumn("rank", F.row_number().over(inside).cast("long"))
    if weight:
        df = df.withColumn("before", F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    df = df.join(offsets, ["key", "bucket"]).withColumn("rank", F.col("rank") + F.col("c0"))
    if weight:
        df = df.withColumn("before", F.col("before") + F.col("w0"))
    return df.drop("bucket", "c0", "w0", *([] if weight else ["sum"]))


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % 4


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(remainder(doc_id) == 2, F.lit(False))
