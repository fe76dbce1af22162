"""Tables of documents of unknown layout, found on pages and cleaned, and batches of documents.

Documents are asked for one by one; each is as long as a person would look at, longer ones are refused, never cut.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RequestError
from ..operators import grid as grids
from ..sinks import batch_names
from ..sources.pages import search
from .reports import Report, detect, process

# Pages that are looked through when asked for, and when all are; documents of a batch.
GUIDED_PAGES, AUTOMATIC_PAGES, BATCH_DOCUMENTS = 30, 100, 10


def _page_count(pages: DataFrame, doc_id: str) -> int:
    n = pages.where(F.col("doc_id") == doc_id).agg(F.max("page")).first()[0]
    if n is None:
        raise RequestError(f"no document {doc_id}")
    return n


def _on(grid: DataFrame, doc_id: str, wanted: Sequence[int]) -> DataFrame:
    return grids.padded(grid.where((F.col("doc_id") == doc_id) & F.col("page").isin(list(wanted))))


def by_pages(pages: DataFrame, grid: DataFrame, doc_id: str, first: int, last: int) -> DataFrame:
    """All grids on the pages from first to last."""
    if any(type(p) is not int for p in (first, last)):
        raise TypeError("pages are whole numbers")
    total = _page_count(pages, doc_id)
    if not 1 <= first <= last <= total:
        raise RequestError(f"{doc_id} has the pages 1 to {total}")
    if last - first >= GUIDED_PAGES:
        raise RequestError(f"at most {GUIDED_PAGES} pages at a time")
    return _on(grid, doc_id, range(first, last + 1))


def automatically(pages: DataFrame, grid: DataFrame, doc_id: str) -> DataFrame:
    """All grids of a document."""
    total = _page_count(pages, doc_id)
    if total > AUTOMATIC_PAGES:
        raise RequestError(f"{doc_id} has more than {AUTOMATIC_PAGES} pages; ask for some of them")
    return _on(grid, doc_id, range(1, total + 1))


def by_keyword(pages: DataFrame, grid: DataFrame, doc_id: str, keyword: str) -> DataFrame:
    """All grids on pages that hold a keyword; none if no page does."""
    own = pages.where(F.col("doc_id") == doc_id)
    found = [r["page"] for r in search(own, keyword).select("page").distinct().limit(GUIDED_PAGES + 1).collect()]
    if len(found) > GUIDED_PAGES:
        raise RequestError(f"{keyword.strip()!r} stands on more than {GUIDED_PAGES} pages")
    return _on(grid, doc_id, found)


def cleaned(found: DataFrame) -> tuple[dict[str, DataFrame], tuple[str, ...]]:
    """Every section of every grid found as a clean table under its suggested header, and columns to look at.

    Tables without rows or columns are left out.
    """
    sections = grids.split_sections(found)
    number = F.row_number().over(Window.partitionBy(*grids.KEYS, "section_id").orderBy("row_pos")) - 1
    sections = sections.withColumn("row_pos", number)
    places = sections.groupBy("page", "table_index").agg(F.array_sort(F.collect_set("section_id")).alias("ids")).orderBy("page", "table_index").collect()  # of one document
    tables: dict[str, DataFrame] = {}
    notes = []
    for place in places:
        for i, section in enumerate(place["ids"], 1):
            here = (F.col("page") == place["page"]) & (F.col("table_index") == place["table_index"]) & (F.col("section_id") == section)
            part = sections.where(here).drop("section_id", "section_title")
            header = grids.suggested_header(part)
            table = grids.clean_grid(part, header[0] if header else 0, len(header), remove_script=True)
            if len(table.columns) == 1 or table.isEmpty():
                continue
            name = f"page_{place['page']}_table_{place['table_index'] + 1}" + f"_section_{i}" * (len(place["ids"]) > 1) + "_clean.csv"
            tables[name] = table
            if odd := grids.suspicious_columns(table):
                notes.append(f"{name}: columns may be cut or split: {', '.join(odd)}")
    return tables, tuple(notes)


@dataclass(frozen=True)
class Outcome:
    """What became of a document: the report it is, discovery, or failed, for the reason in error."""

    doc_id: str
    method: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    warnings: tuple[str, ...] = ()
    error: str | None = None


def _outcome(pages: DataFrame, grid: DataFrame, doc_id: str, reports: tuple[Report, ...] | None) -> Outcome:
    try:
        tables = {f"{name.replace('.', '_')}.csv": rows for name, rows in process(pages, grid, doc_id, reports).items()}
        return Outcome(doc_id, detect(pages.where(F.col("doc_id") == doc_id), reports).first()["report"], tables)
    except Exception:  # of no known report, or not as that report should be
        tables, notes = cleaned(automatically(pages, grid, doc_id))
    if not tables:
        raise RequestError(f"{doc_id} has no tables")
    return Outcome(doc_id, "discovery", tables, notes)


def batch(pages: DataFrame, grid: DataFrame, doc_ids: Sequence[str], reports: tuple[Report, ...] | None = None) -> list[Outcome]:
    """Documents in the order given, as known reports or else by discovery. One that fails doesn't stop the others."""
    if not 1 <= len(doc_ids) <= BATCH_DOCUMENTS:
        raise RequestError(f"a batch has 1 to {BATCH_DOCUMENTS} documents")
    out = []
    for doc_id in doc_ids:
        try:
            out.append(_outcome(pages, grid, doc_id, reports))
        except Exception as e:
            out.append(Outcome(doc_id, "failed", error=str(e)))
    return out


def counts(outcomes: Sequence[Outcome]) -> dict[str, int]:
    failed = sum(o.error is not None for o in outcomes)
    return {"succeeded": len(outcomes) - failed, "failed": failed, "tables": sum(len(o.tables) for o in outcomes)}


def downloads(outcomes: Sequence[Outcome]) -> dict[str, DataFrame]:
    """All tables of a batch under names that differ."""
    parts = [(o.doc_id, name, rows) for o in outcomes for name, rows in o.tables.items()]
    if not parts:
        raise RequestError("the batch has no tables")
    return dict(zip(batch_names([(d, n) for d, n, _ in parts]), (rows for *_, rows in parts), strict=True))
