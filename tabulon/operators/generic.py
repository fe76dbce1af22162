"""Tables without a profile: types from text, corrections, charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RequestError, UnknownColumn
from ..functions.text import is_missing, lenient_number, named

#: Share of a column's filled cells that must read as numbers.
NUMERIC_SHARE = 0.8


def infer_numbers(df: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Text columns as numbers where at least NUMERIC_SHARE of filled cells read as such.

    One aggregation decides for all columns. Also the number of filled cells that became null, by column.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]
    if not texts:
        return df, {}
    stats = []
    for i, c in enumerate(texts):
        filled, value = ~is_missing(named(c)), lenient_number(named(c))
        stats += [F.count_if(filled).alias(f"f{i}"), F.count(value).alias(f"n{i}"), F.count_if(value.isNotNull() & (value != F.floor(value))).alias(f"d{i}")]
    row = df.agg(*stats).first()
    made, lost = {}, {}
    for i, c in enumerate(texts):
        filled, numbers = row[f"f{i}"], row[f"n{i}"]
        if filled and numbers >= NUMERIC_SHARE * filled:
            value = lenient_number(named(c))
            made[c] = value if row[f"d{i}"] else value.cast("bigint")
            lost[c] = filled - numbers
    return (df.withColumns(made) if made else df), lost


def correct_columns(df: DataFrame, dropped: list[str] = (), renamed: dict[str, str] | None = None) -> DataFrame:
    """Drop, then rename; blank and equal new names change nothing."""
    renamed = {a: b.strip() for a, b in (renamed or {}).items() if b and b.strip() and b.strip() != a}
    if unknown := [c for c in (*dropped, *renamed) if c not in df.columns]:
        raise UnknownColumn(f"no column {', '.join(unknown)}")
    kept = [c for c in df.columns if c not in dropped]
    names = [renamed.get(c, c) for c in kept]
    if not names:
        raise RequestError("no column is left")
    if len(set(names)) < len(names):
        raise RequestError("column names must differ")
    return df.select(*(named(a).alias(b) for a, b in zip(kept, names, strict=True)))


def apply_edits(df: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Cells replaced by (key, column, value) rows; key is unique in df."""
    columns = [c for c in df.columns if c != key]
    wide = edits.groupBy(named(key)).pivot("column", columns).agg(F.struct(F.first("value").alias("v")))
    wide = wide.select(key, *(named(c).alias(f"__{c}") for c in columns))
    changed = [F.when(named(f"__{c}").isNotNull(), F.col(f"`__{c}`.v").cast(df.schema[c].dataType)).otherwise(named(c)).alias(c) for c in columns]
    return df.join(wide, key, "left").select(named(key), *changed)


def chart_data(df: DataFrame, x: str, y: str, aggregation: str = "sum", limit: int = 50, order: str | None = None) -> DataFrame:
    """Category and Value: rows with both, aggregated by x in order of first appearance (of `order`)."""
    functions = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}
    for c in (x, y):
        if c not in df.columns:
            raise UnknownColumn(f"no column {c!r}")
    both = df.where(named(x).isNotNull() & named(y).isNotNull())
    place = named(order) if order else named(x)
    if aggregation == "none":
        return both.select(named(x).alias("Category"), named(y).alias("Value"), place.alias("__at")).orderBy("__at", "Category", "Value").limit(limit).drop("__at")
    if aggregation not in functions:
        raise RequestError(f"unknown aggregation {aggregation!r}")
    groups = both.groupBy(named(x).alias("Category")).agg(functions[aggregation](named(y)).alias("Value"), F.min(place).alias("__at"))
    return groups.orderBy("__at", "Category").limit(limit).drop("__at")


def duplicate_rows(df: DataFrame, place: str, keys: list[str] | None = None) -> DataFrame:
    """Rows equal to an earlier one in `keys` (all others by default); nulls are equal."""
    keys = keys or [c for c in df.columns if c != place]
    order = Window.partitionBy(*map(named, keys)).orderBy(named(place))
    return df.withColumn("__n", F.row_number().over(order)).where("__n > 1").drop("__n")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key stands more than once."""
    return df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*map(named, keys)))).where("__n > 1").drop("__n")
