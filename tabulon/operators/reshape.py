"""Wide to long, lookups and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import RequestError
from ..functions.text import is_missing, named

#: Entries of a lookup that may be part of a plan.
MOST_ENTRIES = 10_000


def melt(df: DataFrame, ids: list[str], value: str, variable: str = "Date", kind: str = "double", date_format: str | None = "d-M-yyyy", order: str | None = None) -> DataFrame:
    """One row per id row and measure column, measures in column order; names that don't parse as dates are errors."""
    measures = [c for c in df.columns if c not in (*ids, order)]
    if not measures:
        raise RequestError("no measure column")
    if date_format:
        parse = df.sparkSession.range(1).select(*(F.try_to_timestamp(F.lit(m), F.lit(date_format)).alias(f"m{i}") for i, m in enumerate(measures))).first()
        if bad := [m for i, m in enumerate(measures) if parse[i] is None]:
            raise RequestError(f"{bad[0]!r} is no date")
    keep = [*ids, *([order] if order else [])]
    cells = [F.struct(F.lit(i).alias("at"), F.lit(m).alias("name"), named(m).cast(kind).alias("v")) for i, m in enumerate(measures)]
    cell = "cell"
    while cell in (c.lower() for c in keep):  # one helper column, of a name that no kept one has
        cell += "_"
    long = df.select(*map(named, keep), F.explode(F.array(*cells)).alias(cell))
    name = F.to_date(F.col(cell)["name"], date_format) if date_format else F.col(cell)["name"]
    return long.select(*map(named, keep), name.alias(variable), F.col(cell)["v"].alias(value), F.col(cell)["at"].alias("measure_pos"))


def paired_melt(df: DataFrame, ids: dict[str, str], headers: dict[str, tuple[str, str]], metrics: dict[str, str], kind: str = "bigint", date_format: str = "d-M-yyyy") -> DataFrame:
    """One row per id row and date with all metrics of that date.

    headers: column -> (date, metric label); metrics: label -> name of the result column. Every date needs each
    metric once.
    """
    dates: dict[str, dict[str, str]] = {}
    for column, (date, label) in headers.items():
        if label not in metrics:
            raise RequestError(f"unknown metric {label!r}")
        if label in dates.setdefault(date, {}):
            raise RequestError(f"{label!r} stands twice for {date}")
        dates[date][label] = column
    for date, found in dates.items():
        if lacking := [m for m in metrics if m not in found]:
            raise RequestError(f"{date} lacks {lacking[0]!r}")
    rows = [F.struct(F.lit(i).alias("date_pos"), F.to_date(F.lit(date), date_format).alias("Date"), *(named(found[label]).cast(kind).alias(out) for label, out in metrics.items())) for i, (date, found) in enumerate(dates.items())]
    keep = [named(c).alias(out) for c, out in ids.items()]
    extra = [named("row_pos")] if "row_pos" in df.columns else []
    return df.select(*keep, *extra, F.inline(F.array(*rows)))


def lookup(key: Column, mapping: dict[str, str]) -> Column:
    if len(mapping) > MOST_ENTRIES:
        raise RequestError("join large mappings as tables")
    return F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))[key] if mapping else F.lit(None).cast("string")


def unmapped_keys(df: DataFrame, key: str, mapping: dict[str, str], order: str | None = None) -> DataFrame:
    """Distinct filled keys that the mapping lacks, in order of first appearance."""
    rows = df.where(~is_missing(named(key)) & lookup(F.trim(named(key).cast("string")), mapping).isNull())
    out = rows.groupBy(named(key).alias("key")).agg(F.min(named(order) if order else named(key)).alias("__at"))
    return out.orderBy("__at", "key").select("key")


def assign_from_mapping(df: DataFrame, key: str, target: str, mapping: dict[str, str], strict: bool = True) -> DataFrame:
    """target by the key's entry; rows without a key keep a filled target. strict: anything unresolved is an error."""
    k, t = named(key), named(target)
    found = lookup(F.trim(k.cast("string")), mapping)
    if strict:
        bad = df.where(F.when(is_missing(k), is_missing(t)).otherwise(found.isNull())).limit(1).collect()
        if bad:
            raise RequestError(f"{bad[0][key]!r} has no {target}")
    return df.withColumn(target, F.when(is_missing(k), t).otherwise(F.coalesce(found, t)))


def reconcile(long: DataFrame, value: str, date: str, is_total: Column, tolerance: float = 1.0) -> DataFrame:
    """By date the sum of parts, the reported total, their difference and whether it is within tolerance.

    One conditional aggregation; reported_rows tells dates that don't have exactly one total.
    """
    total = F.coalesce(is_total, F.lit(False))
    out = long.groupBy(named(date).alias(date)).agg(
        F.sum(F.when(~total, named(value))).alias("component_sum"), F.max(F.when(total, named(value))).alias("reported_total"), F.count_if(total).alias("reported_rows")
    )
    difference = F.col("reported_total") - F.col("component_sum")
    return out.withColumn("difference", difference).withColumn("within_tolerance", F.coalesce(F.abs(difference) <= tolerance, F.lit(False)))


def states_by_total(region: Column, state: Column, label: str = "ALL INDIA") -> Column:
    """A blank state of a total row takes the total's label."""
    return F.when(is_missing(state) & (F.upper(F.trim(region)) == label), F.lit(label)).otherwise(state)
