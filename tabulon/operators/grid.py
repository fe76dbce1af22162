"""Repair of cell grids.

A grid is a DataFrame of (doc_id, page, table_index, row_pos, cells array<string>); keys name one grid,
row_pos orders its rows. Windows are always partitioned by those keys, so grids of many documents are
repaired side by side.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RequestError
from ..functions.names import label_text, unique_names
from ..functions.text import clean_cell, collapse, is_data_like, is_missing, named

KEYS = ("doc_id", "page", "table_index")
GRID = "doc_id string, page int, table_index int, row_pos int, cells array<string>"
#: Rows from the top among which a header is looked for, and rows a header spans at most above its data.
HEADER_SCAN, HEADER_ROWS = 15, 4
# Headers of free-text columns, whose cells run on over several rows.
NARRATIVE_CUES = ("action", "comment", "description", "detail", "narrative", "note", "observation", "remark")


def grid_of(spark, rows: list[list], doc_id: str = "doc", page: int = 1, table_index: int = 0) -> DataFrame:
    """A grid from Python rows; ragged rows are filled up with nulls."""
    if not rows:
        raise RequestError("a table has rows")
    width = max(map(len, rows))
    return spark.createDataFrame([(doc_id, page, table_index, i, [None if c is None else str(c) for c in r] + [None] * (width - len(r))) for i, r in enumerate(rows)], GRID)


def filled(cells: Column | str = "cells") -> Column:
    return F.filter(cells, lambda c: ~is_missing(c))


def padded(grid: DataFrame) -> DataFrame:
    """All rows of a grid as wide as its widest."""
    width = F.max(F.size("cells")).over(Window.partitionBy(*KEYS))
    return grid.withColumn("__w", width).withColumn("cells", F.concat("cells", F.array_repeat(F.lit(None).cast("string"), F.col("__w") - F.size("cells")))).drop("__w")


def span(grid: DataFrame, doc_id: str, pages: list[int], table_index: int = 0) -> DataFrame:
    """The same table of ascending pages as one grid, rows numbered through, ragged widths filled up."""
    if not pages or sorted(set(pages)) != list(pages):
        raise RequestError("pages must ascend")
    rows = grid.where((F.col("doc_id") == doc_id) & F.col("page").isin(pages) & (F.col("table_index") == table_index))
    have = {r["page"] for r in rows.select("page").distinct().collect()}  # at most the pages asked for
    if lacking := [p for p in pages if p not in have]:
        raise RequestError(f"no table {table_index} on page {lacking[0]}")
    number = F.row_number().over(Window.partitionBy("doc_id", "table_index").orderBy("page", "row_pos")) - 1
    return padded(rows.withColumn("row_pos", number).withColumn("page", F.lit(pages[0])))


def shape(grid: DataFrame) -> DataFrame:
    return grid.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("cells")).alias("n_columns"))


def head(grid: DataFrame, rows: int = HEADER_SCAN) -> list[list[str | None]]:
    """The first rows of a single grid, on the driver."""
    return [r["cells"] for r in grid.where(F.col("row_pos") < rows).orderBy("row_pos").limit(rows).collect()]


def columns(grid: DataFrame, names: list[str], after: int) -> DataFrame:
    """Rows after `after` as a table: row_pos and one column per name."""
    return grid.where(F.col("row_pos") > after).select("row_pos", *(F.col("cells")[i].alias(n) for i, n in enumerate(names)))


def promote_header(grid: DataFrame, row: int = 0) -> DataFrame:
    """A row as the names, exactly; rows up to it go."""
    found = grid.where(F.col("row_pos") == row).select("cells").limit(1).collect()
    if not found:
        raise RequestError(f"no row {row}")
    names = found[0]["cells"]
    if any(n is None or not n.strip() for n in names):
        raise RequestError("a header cell is blank")
    return columns(grid, names, row)


def fill_right(cells: list[str | None], start: int = 0) -> list[str]:
    out: list[str] = []
    for i, c in enumerate(cells):
        blank = c is None or not str(c).strip()
        out.append(out[i - 1] if blank and i > start else "" if blank else str(c))
    return out


@dataclass(frozen=True)
class WideTable:
    """A table with headers of several levels: columns c0.. and each one's labels."""

    rows: DataFrame
    headers: tuple[tuple[str, ...], ...]

    def flat(self) -> DataFrame:
        names = unique_names([" | ".join(p for p in h if p) or f"Column_{i}" for i, h in enumerate(self.headers)])
        return self.rows.select("row_pos", *(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))


def promote_levels(grid: DataFrame, rows: list[int], fill_from: int | None = None) -> WideTable:
    """Consecutive rows as header levels; with fill_from, blanks take the label to their left from that column on."""
    if len(rows) < 2 or rows != list(range(rows[0], rows[0] + len(rows))):
        raise RequestError("header rows must be two or more in a row")
    found = [r["cells"] for r in grid.where(F.col("row_pos").isin(rows)).orderBy("row_pos").collect()]  # the header rows asked for
    if len(found) < len(rows):
        raise RequestError("header rows lie outside the table")
    levels = [fill_right(r, fill_from) if fill_from is not None else ["" if c is None or not c.strip() else c for c in r] for r in found]
    body = columns(grid, [f"c{i}" for i in range(len(levels[0]))], rows[-1])
    return WideTable(body, tuple(zip(*levels, strict=True)))


def forward_fill(df: DataFrame, names: list[str], order: str = "row_pos", by: list[str] = (), blank_is_missing: bool = True) -> DataFrame:
    """Missing cells take the last value above."""
    upto = Window.partitionBy(*map(named, by)).orderBy(named(order)).rowsBetween(Window.unboundedPreceding, 0)
    gone = (lambda c: is_missing(c)) if blank_is_missing else (lambda c: c.isNull())
    return df.withColumns({n: F.last(F.when(~gone(named(n)), named(n)), ignorenulls=True).over(upto) for n in names})


def suggest_header(rows: list[list[str | None]], data_like) -> list[int]:
    """Rows just above the first that holds data (data_like tells what a data cell is); none without data or if that is the first row.

    Going up from the data, sparse rows count once a denser one stands above them, and end the header above it.
    """
    width = max(map(len, rows), default=0)
    first = next((i for i, r in enumerate(rows[:HEADER_SCAN]) if sum(bool(c) and data_like(c) for c in r) >= max(2, int(0.4 * width))), 0)
    dense = [sum(c is not None and bool(c.strip()) for c in r) > max(1, width // 5) for r in rows[:first]]
    near = range(max(0, first - HEADER_ROWS), first)
    last = max((i for i in near if dense[i]), default=None)
    if last is None:
        return []
    top = last
    while top - 1 in near and dense[top - 1]:
        top -= 1
    return list(range(top, first))


def suggested_header(grid: DataFrame) -> list[int]:
    top = grid.where(F.col("row_pos") < HEADER_SCAN).select("row_pos", F.transform("cells", is_data_like).alias("d"), "cells").orderBy("row_pos").limit(HEADER_SCAN).collect()
    marks = [[(c or "") if not d else "\u0000" for c, d in zip(r["cells"], r["d"], strict=True)] for r in top]
    return suggest_header(marks, lambda c: c == "\u0000")


def combined_names(block: list[list[str | None]]) -> list[str]:
    """One name per column from some header rows: distinct parts joined by |, blanks numbered, repeats numbered."""
    rows = []
    for r in block:
        some = sum(c is not None and bool(c.strip()) for c in r)
        rows.append(fill_right(r) if some > 1 else ["" if c is None else c for c in r])
    names = []
    for i, parts in enumerate(zip(*rows, strict=True)):
        kept: dict[str, str] = {}
        for p in parts:
            plain = p.strip()
            if plain:
                kept.setdefault(plain.casefold(), plain)
        names.append(" | ".join(kept.values()) or f"Column_{i + 1}")
    return unique_names(names)


def column_stats(grid: DataFrame) -> DataFrame:
    """By grid and column: filled cells, first and last filled row; one aggregation for all of them."""
    cells = grid.select(*KEYS, "row_pos", F.posexplode("cells").alias("column", "cell"))
    full = ~is_missing(F.col("cell"))
    return cells.groupBy(*KEYS, "column").agg(F.count_if(full).alias("n"), F.min(F.when(full, F.col("row_pos"))).alias("first"), F.max(F.when(full, F.col("row_pos"))).alias("last"))


def split_header_columns(block: list[list[str | None]], counts: list[int]) -> dict[int, int]:
    """Columns filled in the header only, each with the nearest unlabelled column of data (the left one of two) it belongs to."""
    labelled = [any(c is not None and c.strip() for c in col) for col in zip(*block, strict=True)]
    bare = [i for i, (label, n) in enumerate(zip(labelled, counts, strict=True)) if not label and n]
    loose = [i for i, (label, n) in enumerate(zip(labelled, counts, strict=True)) if label and not n]
    return {i: min(bare, key=lambda b: (abs(b - i), b > i, b)) for i in loose} if bare else {}


def clean_grid(grid: DataFrame, header: int = 0, header_rows: int = 1, drop_empty: bool = True, remove_script: bool = False, remove_repeats: bool = True, merge_wrapped: bool = True) -> DataFrame:
    """One grid as a clean table: cells cleaned, headers joined and promoted, repeats and wraps repaired, empties dropped.

    With no header rows the columns are named by their places from 0, and no row repeats a header.
    """
    grid = grid.withColumn("cells", F.transform("cells", lambda c: clean_cell(c, remove_script)))
    block = [r["cells"] for r in grid.where(F.col("row_pos").between(header, header + header_rows - 1)).orderBy("row_pos").limit(header_rows).collect()] if header_rows else []
    if len(block) < header_rows:
        raise RequestError("header rows lie outside the table")
    if not block:
        block = [[None] * (grid.agg(F.max(F.size("cells"))).first()[0] or 0)]
    width = len(block[0])
    counts = {r["column"]: r["n"] for r in column_stats(grid.where(F.col("row_pos") >= header + header_rows)).collect()}  # a row per column
    moves = split_header_columns(block, [counts.get(i, 0) for i in range(width)])
    for row in block:
        for a, b in moves.items():
            row[b] = "\n".join(x for x in (row[b], row[a]) if x and x.strip()) or None
    kept = [i for i in range(width) if i not in moves]
    names = combined_names([[row[i] for i in kept] for row in block]) if header_rows else [str(i) for i in kept]
    body = grid.where(F.col("row_pos") >= header + header_rows).withColumn("cells", F.array(*(F.col("cells")[i] for i in kept)))
    if remove_repeats and header_rows:
        body = body.where(~repeated_header(names))
    if merge_wrapped:
        body = merge_continuations(body, names)
    if drop_empty:
        body = body.where(F.size(filled()) > 0)
        left = {r["column"] for r in column_stats(body).where("n > 0").collect()}
    else:
        left = set(range(len(names)))
    return body.select("row_pos", *(F.when(~is_missing(F.col("cells")[i]), F.col("cells")[i]).alias(n) for i, n in enumerate(names) if i in left))


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def repeated_header(names: list[str]) -> Column:
    """Does a row repeat the header: two or more filled cells, three fifths of which say what the column's name says?"""
    same = []
    for i, name in enumerate(names):
        label, cell = label_text(name), _plain(F.col("cells")[i])
        hit = (cell == label) | ((F.length(cell) >= 3) & F.contains(F.lit(label), cell))
        same.append(F.when(~is_missing(F.col("cells")[i]) & hit, 1).otherwise(0))
    n = F.size(filled())
    return (n >= 2) & (sum(same[1:], same[0]) >= 0.6 * n)


def _cell(i: int):
    """Of a record part, its cell i (a lambda with a default would be given the place as well)."""
    return lambda part: part["cells"][i]


def merge_continuations(grid: DataFrame, names: list[str]) -> DataFrame:
    """Rows that only go on with free text, added to the row above with one space.

    Such a row has no first cell and 1 to width / 4 filled cells, all in narrative columns.
    """
    narrative = [i for i, n in enumerate(names) if any(cue in n.lower() for cue in NARRATIVE_CUES)]
    if not narrative:
        return grid
    flags = [~is_missing(F.col("cells")[i]) for i in range(len(names))]
    inside = sum((F.when(flags[i], 1).otherwise(0) for i in narrative), F.lit(0))
    n = F.size(filled())
    goes_on = is_missing(F.col("cells")[0]) & n.between(1, max(1, len(names) // 4)) & (inside == n)
    by = Window.partitionBy(*KEYS).orderBy("row_pos")
    rows = grid.withColumn("__new", F.when(goes_on & (F.row_number().over(by) > 1), 0).otherwise(1))
    rows = rows.withColumn("__id", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("row_pos", "cells")))
    merged = rows.groupBy(*KEYS, "__id").agg(F.min("row_pos").alias("row_pos"), parts.alias("p"))
    cells = []
    for i in range(len(names)):
        first = F.col("p")[0]["cells"][i]
        cells.append(F.when(F.size("p") == 1, first).otherwise(F.nullif(F.array_join(F.filter(F.transform("p", _cell(i)), lambda c: ~is_missing(c)), " "), F.lit(""))) if i in narrative else first)
    return merged.select(*KEYS, "row_pos", F.array(*cells).alias("cells"))


def split_sections(grid: DataFrame) -> DataFrame:
    """Grid rows with section_id and section_title: a sparse row that starts like '2. Title' opens a section."""
    text = F.array_join(filled(), " ")
    opens = (F.size(filled()) <= F.greatest(F.lit(2), F.floor(F.size("cells") / 4))) & text.rlike(r"(?:^|\s)[0-9]+\.\s+[A-Za-z]")
    by = Window.partitionBy(*KEYS).orderBy("row_pos")
    rows = grid.withColumn("__open", F.when(opens & (F.col("row_pos") > F.min("row_pos").over(Window.partitionBy(*KEYS))), 1).otherwise(0))
    rows = rows.withColumn("section_id", F.sum("__open").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    title = F.first(collapse(text)).over(Window.partitionBy(*KEYS, "section_id").orderBy("row_pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    title = F.when(title == "", F.concat(F.lit("Table section "), F.col("section_id") + 1)).when(F.length(title) > 90, F.concat(F.substring(title, 1, 87), F.lit("..."))).otherwise(title)
    return rows.withColumn("section_title", title).drop("__open")


def suspicious_columns(df: DataFrame) -> list[str]:
    """Filled Column_N columns, each with a very short name to its left, in the order of the table."""
    names = [c for c in df.columns if c != "row_pos"]
    numbered = [c for c in names if re.fullmatch(r"column_[0-9]+", c, re.IGNORECASE)]
    if not numbered:
        return []
    row = df.agg(*(F.max(~is_missing(named(c))).alias(f"f{i}") for i, c in enumerate(numbered))).first()
    found = {c for i, c in enumerate(numbered) if row[f"f{i}"]}
    found |= {a for a, b in zip(names, names[1:], strict=False) if b in found and len(re.sub(r"\W+", "", a)) <= 4}
    return [c for c in names if c in found]


def normalise_span(grid: DataFrame) -> DataFrame:
    """Pages of one table at its usual width (the smallest of the most frequent): on wider pages, columns
    filled only in leading rows are joined, by line breaks, into the nearest column that stays."""
    widths = grid.groupBy("page").agg(F.max(F.size("cells")).alias("w"))
    target = widths.groupBy("w").count().orderBy(F.desc("count"), "w").first()["w"]
    stats = column_stats(grid).join(widths, "page").where(F.col("w") > target).orderBy("page", "column").collect()  # a row per column of wide pages
    plan: dict[int, list[list[int]]] = {}
    for page in sorted({r["page"] for r in stats}):
        own = [r for r in stats if r["page"] == page]
        spare = [r["column"] for r in own if r["n"] == 0 or r["last"] - r["first"] + 1 == r["n"] and r["first"] == 0]
        spare = sorted(spare, key=lambda c: next(r["n"] for r in own if r["column"] == c))[: len(own) - target]
        kept = [r["column"] for r in own if r["column"] not in spare]
        if len(kept) == target:
            into: dict[int, list[int]] = {k: [k] for k in kept}
            for c in spare:
                into[min(kept, key=lambda k: (abs(k - c), k))].append(c)
            plan[page] = [sorted(into[k]) for k in kept]
    cells = F.col("cells")
    out = F.when(F.lit(False), cells)
    for page, groups in plan.items():
        made = []
        for group in groups:
            parts = F.array_distinct(F.filter(F.array(*(cells[i] for i in group)), lambda c: ~is_missing(c)))
            made.append(F.when(F.size(parts) > 0, F.array_join(parts, "\n")))
        out = out.when(F.col("page") == page, F.array(*made))
    return padded(grid.withColumn("cells", out.otherwise(cells)))


def stitch_records(grid: DataFrame, pattern: str, fields: Column, comments_from: Column | int) -> DataFrame:
    """Records that start where the first cell matches pattern: id, row_pos, fields of the first row, comments of all rows.

    fields is an array of cells of the first row; comments are all filled cells from comments_from on, row by row. Rows
    before the first record go.
    """
    by = Window.partitionBy(*KEYS).orderBy("row_pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.withColumn("__id", F.sum(F.when(F.coalesce(collapse(F.col("cells")[0]).rlike(pattern), F.lit(False)), 1).otherwise(0)).over(by)).where("__id > 0")
    at = F.lit(comments_from) if isinstance(comments_from, int) else comments_from
    at = F.first(at).over(Window.partitionBy(*KEYS, "__id").orderBy("row_pos"))
    rows = rows.withColumn("__f", fields).withColumn("__c", F.filter(F.slice("cells", at + 1, F.greatest(F.size("cells") - at, F.lit(0))), lambda c: ~is_missing(c)))
    out = rows.groupBy(*KEYS, "__id").agg(F.min("row_pos").alias("row_pos"), F.min_by("__f", "row_pos").alias("fields"), F.array_sort(F.collect_list(F.struct("row_pos", "__c"))).alias("p"))
    return out.select(*KEYS, "row_pos", "fields", collapse(F.array_join(F.flatten(F.transform("p", lambda r: r["__c"])), " ")).alias("comments"))
