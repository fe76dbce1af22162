"""What questions about the known reports can ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import RequestError
from .engine import Table
from .language import Catalog, Dimension, Metric, QuestionEngine
from .reports import CURRENT_COLUMNS, LATE_COLUMNS, OUTBREAKS, POWER, detect, finished, process

# Words that name the dimensions and metrics of the reports.
PLACES = (Dimension("Region", ("region", "regions")), Dimension("State", ("state", "states")))
OUTBREAK_DIMENSIONS = (
    Dimension("State_UT", ("state", "states", "state ut", "states uts")),
    Dimension("District", ("district", "districts")),
    Dimension("Disease_Illness", ("disease", "diseases", "illness", "illnesses")),
    Dimension("Current_Status", ("status", "statuses")),
)
ENERGY_ROW = ("Region", "State", "Date", "Energy_Consumption_MU")
DEMAND_ROW = ("Region", "State", "Date", "Maximum_Demand_MW", "Peak_Shortage_MW")
START = "Outbreak_Start_Date"

POWER_CATALOG = Catalog((
    Metric("energy consumption", "energy_consumption", "Energy_Consumption_MU", ("energy consumption", "energy consumed", "energy"), ENERGY_ROW, PLACES, "sum", "Date", (("Region", "ALL INDIA"),)),
    Metric("maximum demand", "maximum_demand", "Maximum_Demand_MW", ("maximum demand", "max demand", "demand"), DEMAND_ROW, PLACES, "max", "Date"),
    Metric("peak shortage", "maximum_demand", "Peak_Shortage_MW", ("peak shortage", "peak deficit", "shortage"), DEMAND_ROW, PLACES, "max", "Date"),
))
OUTBREAK_CATALOG = Catalog((
    Metric("current outbreak cases", "current_outbreaks", "Cases", ("current outbreak cases", "outbreak cases", "reported cases", "cases"), CURRENT_COLUMNS, OUTBREAK_DIMENSIONS, "sum", START),
    Metric("current outbreak deaths", "current_outbreaks", "Deaths", ("current outbreak deaths", "outbreak deaths", "reported deaths", "deaths"), CURRENT_COLUMNS, OUTBREAK_DIMENSIONS, "sum", START),
    Metric("late outbreak cases", "late_outbreaks", "Cases", ("late outbreak cases", "late reported cases", "late cases"), LATE_COLUMNS, OUTBREAK_DIMENSIONS, "sum", START),
    Metric("late outbreak deaths", "late_outbreaks", "Deaths", ("late outbreak deaths", "late reported deaths", "late deaths"), LATE_COLUMNS, OUTBREAK_DIMENSIONS, "sum", START),
))
CATALOGS = {POWER.name: POWER_CATALOG, OUTBREAKS.name: OUTBREAK_CATALOG}


def questions(pages: DataFrame, grid: DataFrame, doc_id: str) -> QuestionEngine:
    """Questions about a document of a known report, over its finished tables."""
    tables = {name: Table(rows, ("row_pos",)) for name, rows in finished(process(pages, grid, doc_id)).items()}
    found = detect(pages.where(pages["doc_id"] == doc_id)).first()
    if found["report"] not in CATALOGS:
        raise RequestError(f"no questions are known for {found['report']}")
    return QuestionEngine(CATALOGS[found["report"]], tables)
