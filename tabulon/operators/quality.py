"""Read-only reports on tables and checks against contracts."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import RequestError
from ..functions.text import all_of, any_of, is_date_like, is_missing, is_number_like, named
from .generic import duplicate_keys, duplicate_rows

SCAN_ROWS = 5


def _columns(df: DataFrame, place: str) -> list[str]:
    return [c for c in df.columns if c != place]


def missing_by_column(df: DataFrame, place: str = "row_pos") -> dict[str, int]:
    names = _columns(df, place)
    row = df.agg(*(F.count_if(is_missing(named(c))).alias(f"m{i}") for i, c in enumerate(names))).first()
    return {c: row[i] for i, c in enumerate(names)}


def missing_by_row(df: DataFrame, place: str = "row_pos") -> DataFrame:
    return df.select(named(place), sum((F.when(is_missing(named(c)), 1).otherwise(0) for c in _columns(df, place)), F.lit(0)).alias("n_missing"))


def empty_rows(df: DataFrame, place: str = "row_pos") -> DataFrame:
    return df.where(all_of([is_missing(named(c)) for c in _columns(df, place)])).select(named(place))


def date_cells(df: DataFrame, place: str = "row_pos") -> DataFrame:
    """(row, column, value) of every date-like cell."""
    cells = [F.struct(F.lit(c).alias("column"), named(c).cast("string").alias("value")) for c in _columns(df, place)]
    return df.select(named(place), F.inline(F.array(*cells))).where(is_date_like(F.col("value")))


def merged_like_columns(df: DataFrame, place: str = "row_pos") -> list[str]:
    """Columns with missing cells between filled ones (place numbers rows without gaps)."""
    names = _columns(df, place)
    stats = []
    for i, c in enumerate(names):
        at = F.when(~is_missing(named(c)), named(place))
        stats += [F.min(at).alias(f"a{i}"), F.max(at).alias(f"b{i}"), F.count(at).alias(f"n{i}")]
    row = df.agg(*stats).first()
    return [c for i, c in enumerate(names) if row[f"n{i}"] and row[f"b{i}"] - row[f"a{i}"] + 1 > row[f"n{i}"]]


def _profile(values: list[Any], dates: list[bool], numbers: list[bool]) -> tuple[int, int, int, int]:
    full = [v is not None and str(v).strip() != "" for v in values]
    return sum(full), sum(dates), sum(numbers), sum(f and not d and not n for f, d, n in zip(full, dates, numbers, strict=True))


def _top(df: DataFrame, place: str, rows: int) -> list[tuple[int, int, int, int]]:
    names = _columns(df, place)
    picked = df.orderBy(named(place)).limit(rows).select(
        F.array(*(named(c).cast("string") for c in names)).alias("v"), F.array(*(is_date_like(named(c)) for c in names)).alias("d"), F.array(*(is_number_like(named(c)) for c in names)).alias("n")
    )
    return [_profile(r["v"], r["d"], r["n"]) for r in picked.collect()]


def title_rows(top: list[tuple[int, int, int, int]], width: int, most: int | None = None) -> list[int]:
    """Leading rows of a few text cells above a denser row."""
    if width < 2:
        return []
    most = most or max(1, min(3, width // 4))
    out: list[int] = []
    for i, (full, dates, numbers, _) in enumerate(top):
        if not full and out:
            continue
        if not 1 <= full <= most or dates or numbers:
            break
        out.append(i)
    return out if out and any(p[0] > most for p in top[out[-1] + 1 :]) else []


def header_rows(top: list[tuple[int, int, int, int]], titles: list[int]) -> list[int]:
    """Rows that label what is below: with dates, or text above rows with numbers."""
    out: list[int] = []
    for i, (full, dates, numbers, texts) in enumerate(top):
        if i in titles or not full:
            continue
        if numbers > 0:
            break
        below = any(p[2] > 0 for p in top[i + 1 :])
        if dates or texts >= 2 and below or out and below:
            out.append(i)
        elif out:
            break
    return out


def quality_report(df: DataFrame, place: str = "row_pos", scan_rows: int = SCAN_ROWS) -> dict[str, Any]:
    """What is odd about a table: shape, missing cells, empties, duplicates, titles, headers, dates, merged cells.

    Positions of rows are listed, so this is for tables that a person would read.
    """
    names = _columns(df, place)
    df = df.persist()
    try:
        rows, by_column = df.count(), missing_by_column(df, place)
        top = _top(df, place, scan_rows)
        titles = title_rows(top, len(names))
        headers = header_rows(top, titles)
        dates = [tuple(r) for r in date_cells(df, place).orderBy(place).collect()]
        report: dict[str, Any] = {
            "row_count": rows, "column_count": len(names), "total_missing": sum(by_column.values()), "missing_by_column": {c: n for c, n in by_column.items() if n},
            "missing_by_row": {r[0]: r[1] for r in missing_by_row(df, place).orderBy(place).collect()},
            "empty_rows": [r[0] for r in empty_rows(df, place).orderBy(place).collect()], "empty_columns": [c for c, n in by_column.items() if n == rows],
            "duplicate_rows": [r[0] for r in duplicate_rows(df, place).select(place).orderBy(place).collect()],
            "title_rows": titles, "header_rows": headers, "hierarchical_header": any(b - a == 1 for a, b in zip(headers, headers[1:], strict=False)),
            "date_cells": dates, "merged_like_columns": merged_like_columns(df, place),
        }
    finally:
        df.unpersist()
    says = {"empty_rows": "empty rows", "empty_columns": "empty columns", "duplicate_rows": "repeated rows", "title_rows": "rows that look like titles", "merged_like_columns": "columns that look merged"}
    report["warnings"] = [f"{len(report[k])} {what}" for k, what in says.items() if report[k]]
    return report


@dataclass(frozen=True)
class Contract:
    """What a finished table must be."""

    columns: tuple[str, ...] | None = None
    column_count: int | None = None
    row_count: int | None = None
    required: tuple[str, ...] = ()
    filled: tuple[str, ...] = ()
    unique_key: tuple[str, ...] = ()

    def violations(self, df: DataFrame, place: str = "row_pos") -> list[str]:
        names = _columns(df, place)
        out = []
        if self.columns is not None and tuple(names) != self.columns:
            out.append(f"columns are {', '.join(names)}")
        if self.column_count is not None and len(names) != self.column_count:
            out.append(f"{len(names)} columns instead of {self.column_count}")
        lacking = [c for c in dict.fromkeys((*self.required, *self.filled, *self.unique_key)) if c not in names]
        out += [f"column {c!r} is missing" for c in lacking]
        checks = [c for c in self.filled if c not in lacking]
        row = df.agg(F.count(F.lit(1)), *(F.count_if(is_missing(named(c))) for c in checks)).first()
        if self.row_count is not None and row[0] != self.row_count:
            out.append(f"{row[0]} rows instead of {self.row_count}")
        out += [f"{n} missing cells in {c!r}" for c, n in zip(checks, row[1:], strict=True) if n]
        if self.unique_key and not set(self.unique_key) & set(lacking):
            n = duplicate_keys(df, [*self.unique_key]).count()
            if n:
                out.append(f"{n} rows share a key of {', '.join(self.unique_key)}")
        return out

    def check(self, df: DataFrame, place: str = "row_pos") -> DataFrame:
        if found := self.violations(df, place):
            raise RequestError("; ".join(found))
        return df


def rows_with_missing(df: DataFrame, names: list[str]) -> DataFrame:
    return df.where(any_of([is_missing(named(c)) for c in names]))
