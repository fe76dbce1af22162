"""Compiles requests into lazy plans: nothing runs until a result is asked for."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NoMatchingRows, RequestError, UnknownColumn, UnknownTable
from ..functions.text import all_of, named
from .request import Aggregation, Filter, Request, parse_request

DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _literal(value: Any, kind: T.DataType, column: str) -> Column | None:
    """The value in the column's type; None for null."""
    if value is None:
        return None
    if isinstance(kind, DATES):
        try:
            when = value if isinstance(value, (dt.date, dt.datetime)) else dt.datetime.fromisoformat(str(value).strip())
        except ValueError:
            import pandas as pd

            try:  # month first where that is open, as pandas reads dates
                when = pd.to_datetime(value).to_pydatetime()
            except (ValueError, TypeError) as e:
                raise RequestError(f"{value!r} is no date for {column!r}") from e
        whole_day = not isinstance(when, dt.datetime) or when.time() == dt.time() and when.tzinfo is None
        # in the column's own type, so that the comparison reaches the scan
        return F.lit(str(when)[:10]).cast("date") if isinstance(kind, T.DateType) and whole_day else F.lit(str(when)).cast("timestamp" if isinstance(kind, T.TimestampType) else "timestamp_ntz")
    if isinstance(kind, T.BooleanType):
        if not isinstance(value, (bool, int, float)):
            raise RequestError(f"{value!r} is no truth value for {column!r}")
        return F.lit(bool(value))
    if isinstance(kind, T.NumericType):
        if isinstance(value, str):
            try:
                value = int(value) if value.strip().lstrip("+-").isdigit() else float(value)
            except ValueError as e:
                raise RequestError(f"{value!r} is no number for {column!r}") from e
        if not isinstance(value, (int, float)):
            raise RequestError(f"{value!r} is no number for {column!r}")
        return F.lit(value)
    return F.lit(value)


def predicate(spec: Filter, kind: T.DataType) -> Column:
    """The filter as a condition for WHERE: what is null there is not matched. Bare comparisons reach the scan.

    Null cells, and cells that aren't numbers in columns of floats, are missing: they differ from every value and satisfy no comparison.
    """
    c, op = named(spec.column), spec.operator
    number = isinstance(kind, (T.DoubleType, T.FloatType))
    missing = c.isNull() | F.isnan(c) if number else c.isNull()
    if op == "contains":
        text = F.date_format(c, "yyyy-MM-dd") if isinstance(kind, T.DateType) else c if isinstance(kind, T.StringType) else c.cast("string")
        found = F.contains(text, F.lit(spec.value))
        return found & ~F.isnan(c) if number else found
    if op in ("in", "not_in", "between"):
        values = [_literal(v, kind, spec.column) for v in spec.value]
        if op == "between":
            if any(v is None for v in values):
                raise RequestError("between takes no null")
            return (c >= values[0]) & (c <= values[1])
        if isinstance(kind, T.StringType) and any(not isinstance(v, str) for v in spec.value if v is not None):
            values = [v for v, raw in zip(values, spec.value, strict=True) if raw is None or isinstance(raw, str)]
        known = [v for v in values if v is not None]
        # a listed null finds null cells of text columns, and of dates beside a date
        nulls = len(known) < len(values) and (isinstance(kind, T.StringType) or bool(isinstance(kind, DATES) and known))
        if op == "in":
            inside = c.isin(*known) if known else F.lit(False)
            return inside | c.isNull() if nulls else inside
        outside = ~c.isin(*known) if known else F.lit(True)
        return outside & c.isNotNull() if nulls else outside | c.isNull()
    value = _literal(spec.value, kind, spec.column)
    if value is None:
        if op not in ("eq", "ne"):
            raise RequestError(f"{op} takes no null")
        return missing if op == "eq" else ~missing
    if isinstance(kind, T.StringType) and not isinstance(spec.value, str):
        if op not in ("eq", "ne"):
            raise RequestError(f"{spec.column!r} holds text and can't be compared with {spec.value!r}")
        return F.lit(op == "ne")
    if op == "ne":
        return (c != value) | c.isNull()
    made = {"eq": c == value, "gt": c > value, "gte": c >= value, "lt": c < value, "lte": c <= value}[op]
    return made & ~F.isnan(c) if number and op in ("gt", "gte") else made


def aggregate(spec: Aggregation, kind: T.DataType) -> Column:
    c, op = named(spec.column), spec.operation
    if op in ("sum", "mean", "median"):
        if not isinstance(kind, (T.NumericType, T.BooleanType)):
            raise RequestError(f"{op} of {spec.column!r} requires a numeric column")
        if isinstance(kind, T.BooleanType):
            c = c.cast("int")
    made = {
        "sum": lambda: F.coalesce(F.sum(c), F.lit(0)), "mean": lambda: F.avg(c), "median": lambda: F.median(c),
        "min": lambda: F.min(c), "max": lambda: F.max(c), "count": lambda: F.count(c), "nunique": lambda: F.count_distinct(c),
    }[op]()
    return made.alias(spec.alias)


def without_nan(df: DataFrame) -> DataFrame:
    """Not-a-number cells as nulls."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({n: F.nanvl(named(n), F.lit(None).cast("double")).cast(df.schema[n].dataType) for n in floats}) if floats else df


@dataclass(frozen=True)
class Table:
    """A registered table; order_by (unique together) gives its rows an order for ties and first appearance."""

    rows: DataFrame
    order_by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Result:
    """An answer and the rows behind it, both lazy."""

    request: Request
    source: DataFrame
    matched: DataFrame
    answer: DataFrame
    table: Table

    def evidence(self, limit: int = 20) -> DataFrame:
        keys = [named(c).asc_nulls_last() for c in self.table.order_by]
        return (self.matched.orderBy(*keys) if keys else self.matched).limit(limit)

    def counts(self) -> dict[str, int]:
        """Rows of the source, matched, and returned; no match is an error."""
        matched = self.matched.count()
        if not matched:
            raise NoMatchingRows(f"no row of {self.request.table!r} matches")
        return {"source_row_count": self.source.count(), "matched_row_count": matched, "returned_row_count": self.answer.count()}

    def rows(self) -> list:
        if self.matched.isEmpty():
            raise NoMatchingRows(f"no row of {self.request.table!r} matches")
        return self.answer.collect()  # at most MOST_ROWS


class Engine:
    """Tables by name, and requests over them."""

    def __init__(self, tables: Mapping[str, DataFrame | Table]):
        self.tables: dict[str, Table] = {}
        for name, table in tables.items():
            if not isinstance(name, str) or not name.strip():
                raise ValueError("a table needs a name")
            if name.strip() in self.tables:
                raise ValueError(f"table {name.strip()!r} is named twice")
            table = table if isinstance(table, Table) else Table(table)
            if table.order_by and set(table.order_by) - set(table.rows.columns):
                raise UnknownColumn(f"order columns of {name!r} don't exist")
            self.tables[name.strip()] = table

    def describe(self) -> dict[str, dict[str, str]]:
        return {n: dict(t.rows.dtypes) for n, t in self.tables.items()}

    def compile(self, request: Request | Mapping[str, Any] | str) -> Result:
        """The lazy plan: filters first, then groups or columns, order, limit; no job runs."""
        request = request if isinstance(request, Request) else parse_request(request)
        if request.table not in self.tables:
            raise UnknownTable(f"no table {request.table!r}; there are {', '.join(sorted(self.tables))}")
        table = self.tables[request.table]
        kinds = {f.name: f.dataType for f in table.rows.schema}
        asked = [*request.columns, *request.group_by, *(f.column for f in request.filters), *(a.column for a in request.aggregations)]
        if lacking := [c for c in dict.fromkeys(asked) if c not in kinds]:
            raise UnknownColumn(f"no column {', '.join(map(repr, lacking))} in {request.table!r}")
        matched = table.rows.where(all_of([predicate(f, kinds[f.column]) for f in request.filters])) if request.filters else table.rows
        matched = without_nan(matched)  # after the filter: that one is left as the scan can use it
        place = F.struct(*map(named, table.order_by)) if table.order_by else None
        hidden = "__place"
        if request.aggregations:
            made = [aggregate(a, kinds[a.column]) for a in request.aggregations]
            names = [*request.group_by, *(a.alias for a in request.aggregations)]
            if request.group_by and place is not None:
                answer = matched.groupBy(*map(named, request.group_by)).agg(*made, F.min(place).alias(hidden))
            else:
                answer = matched.groupBy(*map(named, request.group_by)).agg(*made)
            if request.group_by:  # groups without rows don't exist; a scalar answer over no rows is caught by counts()
                answer = answer.select(*map(named, names), *([hidden] if place is not None else []))
        else:
            names = [*request.columns] or table.rows.columns
            answer = matched.select(*map(named, names), *([place.alias(hidden)] if place is not None else []))
        if lacking := [o.column for o in request.order_by if o.column not in names]:
            raise UnknownColumn(f"can't order by {', '.join(map(repr, lacking))}: not in the answer")
        keys = [named(o.column).asc_nulls_last() if o.direction == "asc" else named(o.column).desc_nulls_last() for o in request.order_by]
        if hidden in answer.columns:
            keys.append(F.col(hidden).asc_nulls_last())
        elif request.group_by:
            keys += [named(c).asc_nulls_last() for c in request.group_by]
        elif request.order_by:
            keys += [named(c).asc_nulls_last() for c in names]
        answer = (answer.orderBy(*keys) if keys else answer).limit(request.limit)
        return Result(request, without_nan(table.rows), matched, answer.select(*map(named, names)), table)

    def ask(self, request: Request | Mapping[str, Any] | str) -> list:
        return self.compile(request).rows()
