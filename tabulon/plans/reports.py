"""Known reports: how a document is recognised, where its tables stand and what becomes of them.

A report is declared with marks (terms that all occur in its pages) and tables; a table has terms of its first page, may
have terms of the page that ends it, and a function from its grid to finished tables with their contracts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import RequestError
from ..functions.text import clean_cell, collapse, is_missing, lenient_number, named, repair_wrapped_name
from ..operators import grid as grids
from ..operators.quality import Contract
from ..operators.reshape import assign_from_mapping, melt, paired_melt, states_by_total
from ..sources.pages import matching_profiles


@dataclass(frozen=True)
class Output:
    rows: DataFrame
    contract: Contract


@dataclass(frozen=True)
class ReportTable:
    """starts: terms of the first page, of which the `match`-th (from 0) counts; ends: terms of the closing page."""

    name: str
    starts: tuple[str, ...]
    build: Callable[[DataFrame], dict[str, Output]]
    ends: tuple[str, ...] = ()
    with_end: bool = False
    match: int = 0
    table_index: int = 0

    def __post_init__(self) -> None:
        if not self.name.strip() or not self.starts or any(not t.strip() for t in (*self.starts, *self.ends)):
            raise RequestError("a table has a name and terms that aren't blank")
        if self.match < 0 or self.table_index < 0:
            raise RequestError("positions count from 0")
        if self.with_end and not self.ends:
            raise RequestError(f"{self.name} has no end to include")


@dataclass(frozen=True)
class Report:
    name: str
    marks: tuple[str, ...]
    tables: tuple[ReportTable, ...]

    def __post_init__(self) -> None:
        if not self.name.strip() or not self.marks or not self.tables or any(not t.strip() for t in self.marks):
            raise RequestError("a report has a name, marks and tables")
        if len({t.name for t in self.tables}) < len(self.tables):
            raise RequestError(f"two tables of {self.name} share a name")


def detect(pages: DataFrame, reports: tuple[Report, ...] | None = None) -> DataFrame:
    """(doc_id, report, status): status is known, unknown or ambiguous; report is null unless known.

    One aggregation over all documents' pages, a column per distinct mark.
    """
    known = REPORTS if reports is None else reports
    found = matching_profiles(pages, {r.name: list(r.marks) for r in known})
    n = F.size("profiles")
    return found.select("doc_id", F.when(n == 1, F.col("profiles")[0]).alias("report"), F.when(n == 1, "known").when(n == 0, "unknown").otherwise("ambiguous").alias("status"))


def _page_has(terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(F.lower("text"), F.lit(t.strip().lower())) for t in terms])


def locate(pages: DataFrame, table: ReportTable) -> DataFrame:
    """(doc_id, first_page, last_page) of a table in every document that has it whole.

    first_page is the match-th page with all starting terms. The table ends there, or given ending terms on the
    first later page that has them all, or the one before it. A document without the start or the end has no row.
    """
    at = pages.select("doc_id", "page", _page_has(table.starts).alias("start"), (_page_has(table.ends) if table.ends else F.lit(False)).alias("end"))
    by_doc = at.where("start or end").groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("start"), F.col("page")))).alias("starts"), F.array_sort(F.collect_set(F.when(F.col("end"), F.col("page")))).alias("ends")
    )
    first = by_doc.select("doc_id", F.get("starts", F.lit(table.match)).alias("first_page"), "ends").where("first_page is not null")
    if not table.ends:
        return first.select("doc_id", "first_page", F.col("first_page").alias("last_page"))
    closing = F.get(F.filter("ends", lambda p: p > F.col("first_page")), F.lit(0))
    return first.select("doc_id", "first_page", (closing if table.with_end else closing - 1).alias("last_page")).where("last_page is not null")


def table_grid(pages: DataFrame, grid: DataFrame, doc_id: str, table: ReportTable) -> DataFrame:
    """The cells of a located table of one document, pages joined."""
    place = locate(pages.where(F.col("doc_id") == doc_id), table).first()
    if place is None:
        raise RequestError(f"{table.name} isn't in {doc_id}")
    return grids.span(grid, doc_id, list(range(place["first_page"], place["last_page"] + 1)), table.table_index)


def process(pages: DataFrame, grid: DataFrame, doc_id: str, reports: tuple[Report, ...] | None = None) -> dict[str, DataFrame]:
    """All finished tables of a document as `table` or `table.output`, each checked against its contract."""
    known = REPORTS if reports is None else reports
    found = detect(pages.where(F.col("doc_id") == doc_id), known).first()
    if found is None or found["status"] != "known":
        raise RequestError(f"{doc_id} is {'ambiguous' if found and found['status'] == 'ambiguous' else 'no known report'}")
    report = next(r for r in known if r.name == found["report"])
    out = {}
    for table in report.tables:
        for name, result in table.build(table_grid(pages, grid, doc_id, table)).items():
            out[f"{table.name}.{name}"] = result.contract.check(result.rows)
    return out


# Members of each region as the weekly power report names them.
REGION_MEMBERS = {
    "NR": ("Punjab", "Haryana", "Rajasthan", "Delhi", "UP", "Uttarakhand", "HP", "J&K", "Chandigarh", "Railways_NR ISTS"),
    "WR": ("Chhattisgarh", "Gujarat", "MP", "Maharashtra", "Goa", "DNHDDPDCL", "AMNSIL", "BALCO", "RIL Jamnagar"),
    "SR": ("Andhra Pradesh", "Telangana", "Karnataka", "Kerala", "Tamil Nadu", "Pondy"),
    "ER": ("Bihar", "DVC", "Jharkhand", "Odisha", "West Bengal", "Sikkim", "Railways_ER ISTS"),
    "NER": ("Arunachal Pradesh", "Assam", "Manipur", "Meghalaya", "Mizoram", "Nagaland", "Tripura"),
}
REGION_OF = {state: region for region, states in REGION_MEMBERS.items() for state in states}
ENERGY_COLUMNS, DEMAND_COLUMNS = 9, 16
# Labels under each date of the demand table, and the columns made of them.
DEMAND_METRICS = {"Max. Demand Met during the day": "Maximum_Demand_MW", "Peak hr Shortage": "Peak_Shortage_MW"}
DATE = "dd-MM-yyyy"


def _stripped(grid: DataFrame) -> DataFrame:
    """Cells without the second script."""
    return grid.withColumn("cells", F.transform("cells", lambda c: clean_cell(F.coalesce(c, F.lit("")), remove_script=True)))


def _wide(rows: DataFrame, names: list[str], width: int) -> DataFrame:
    """Region by state and numbers in the measures; cells that are no numbers become null, which the contracts refuse."""
    if len(names) != width:
        raise RequestError(f"{len(names)} columns instead of {width}")
    if len(set(names)) < len(names) or any(not n.strip() for n in names):
        raise RequestError("headers are blank or stand twice")
    region, state, *measures = names
    rows = rows.withColumns({n: F.when(~is_missing(named(n)), named(n)) for n in (region, state)})
    rows = assign_from_mapping(rows, state, region, REGION_OF)
    return rows.withColumns({n: lenient_number(named(n)) for n in measures})


def _in_date_order(long: DataFrame, at: str, values: list[str]) -> DataFrame:
    """Dates in column order, rows of a date in table order; row_pos carries that order."""
    order = F.col(at).cast("long") * F.lit(1 << 32) + F.col("row_pos")
    return long.select(order.alias("row_pos"), "Region", states_by_total(F.col("Region"), F.col("State")).alias("State"), "Date", *values)


def _long_contract(values: list[str]) -> Contract:
    names = ("Region", "State", "Date", *values)
    return Contract(columns=names, filled=names, unique_key=names[:3])


def energy(grid: DataFrame) -> dict[str, Output]:
    """Energy by state and day: the second row holds the dates."""
    grid = _stripped(grid)
    top = grids.head(grid, 2)
    if len(top) < 2:
        raise RequestError("the energy table has no header")
    names = ["Region", "State", *top[1][2:]]
    wide = _wide(grids.columns(grid, names, 1), names, ENERGY_COLUMNS)
    value = "Energy_Consumption_MU"
    long = _in_date_order(melt(wide, ["Region", "State"], value, date_format=DATE, order="row_pos"), "measure_pos", [value])
    return {"clean": Output(wide, Contract(column_count=ENERGY_COLUMNS)), "long": Output(long, _long_contract([value]))}


def demand(grid: DataFrame) -> dict[str, Output]:
    """Demand and shortage by state and day: the second row holds the dates, once for two columns, the third the metrics."""
    table = grids.promote_levels(_stripped(grid), [1, 2], fill_from=2)
    names = [f"c{i}" for i in range(len(table.headers))]
    wide = _wide(table.rows, names, DEMAND_COLUMNS)
    headers = {f"c{i}": (h[0], h[1]) for i, h in enumerate(table.headers) if i >= 2}
    values = list(DEMAND_METRICS.values())
    long = _in_date_order(paired_melt(wide, {"c0": "Region", "c1": "State"}, headers, DEMAND_METRICS, date_format=DATE), "date_pos", values)
    clean = grids.WideTable(wide, (("Region",), ("State",), *table.headers[2:])).flat()
    return {"clean": Output(clean, Contract(column_count=DEMAND_COLUMNS)), "long": Output(long, _long_contract(values))}


# How an outbreak's identifier is made, and the columns of the two outbreak tables.
OUTBREAK_ID = r"^[A-Z]{2}/[A-Z]{3}/\d{4}/\d+/\d+$"
CURRENT_COLUMNS = ("Unique_ID", "State_UT", "District", "Disease_Illness", "Cases", "Deaths", "Outbreak_Start_Date", "Reporting_Date", "Current_Status", "Comments_Action_Taken")
LATE_COLUMNS = ("Unique_ID", "State_UT", "District", "Disease_Illness", "Cases", "Deaths", "Outbreak_Start_Date", "Current_Status", "Comments_Action_Taken")
CURRENT_WIDTH, LATE_WIDTH = 12, 11
OUTBREAK_NAMES, OUTBREAK_COUNTS, OUTBREAK_DATES = ("State_UT", "District"), ("Cases", "Deaths"), ("Outbreak_Start_Date", "Reporting_Date")


def _cells(*places: int) -> Column:
    return F.array(*(F.col("cells")[p] for p in places))


def _outbreaks(grid: DataFrame, names: tuple[str, ...], width: int, fields: Column, comments_from: Column | int) -> dict[str, Output]:
    """One row per outbreak: `clean` has its dates as text, `analysis` as dates.

    Cells that are missing, counts that are no numbers and dates that are none become null, which the contracts refuse,
    as they do an identifier that stands twice.
    """
    found = grids.shape(grid).first()
    if found is None or found["n_columns"] < width:
        raise RequestError(f"an outbreak table has {width} columns or more")
    records = grids.stitch_records(grid, OUTBREAK_ID, fields, comments_from)
    if records.isEmpty():
        raise RequestError("no row starts with the identifier of an outbreak")
    columns = []
    for i, name in enumerate(names):
        cell = F.col("comments") if name == names[-1] else F.col("fields")[i]
        text = repair_wrapped_name(cell) if name in OUTBREAK_NAMES else collapse(cell)
        text = F.when(~is_missing(text), text)
        columns.append((lenient_number(text) if name in OUTBREAK_COUNTS else text).alias(name))
    clean = records.select("row_pos", *columns)
    dates = {d: F.try_to_timestamp(F.col(d), F.lit("d-M-yyyy")).cast("date") for d in OUTBREAK_DATES if d in names}
    contract = Contract(columns=names, filled=names, unique_key=names[:1])
    return {"clean": Output(clean, contract), "analysis": Output(clean.withColumns(dates), contract)}


def current_outbreaks(grid: DataFrame) -> dict[str, Output]:
    """Outbreaks of the week, whose comments run on over several rows and columns."""
    return _outbreaks(grid, CURRENT_COLUMNS, CURRENT_WIDTH, _cells(*range(9)), 9)


def late_outbreaks(grid: DataFrame) -> dict[str, Output]:
    """Outbreaks reported late. On some pages all is one column further right, and the status three: there the second cell is blank."""
    shifted = is_missing(F.col("cells")[1]) & ~is_missing(F.col("cells")[2])
    fields = F.when(shifted, _cells(0, 2, 3, 4, 5, 6, 7, 10)).otherwise(_cells(*range(8)))
    return _outbreaks(grid, LATE_COLUMNS, LATE_WIDTH, fields, F.when(shifted, 11).otherwise(8))


def finished(outputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Of what process returns the last output of each table, by the table's name: the tables that questions are about."""
    return {name.rpartition(".")[0]: rows for name, rows in outputs.items()}


POWER = Report(
    "weekly_power_report",
    ("Energy Consumption", "Maximum Demand Met"),
    (ReportTable("energy_consumption", ("Energy Consumption",), energy), ReportTable("maximum_demand", ("Maximum Demand Met",), demand)),
)
_LATE = "DISEASE OUTBREAKS OF PREVIOUS WEEKS REPORTED LATE"
OUTBREAKS = Report(
    "weekly_outbreak_report",
    ("WEEKLY OUTBREAK REPORT", "Integrated Disease Surveillance Program"),
    (ReportTable("current_outbreaks", ("Comments/ Action Taken",), current_outbreaks, ends=(_LATE,)), ReportTable("late_outbreaks", (_LATE,), late_outbreaks, ends=("COVID-19 STATUS",), with_end=True)),
)
REPORTS = (POWER, OUTBREAKS)
