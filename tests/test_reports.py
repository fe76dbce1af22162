import datetime

import pytest

from tabulon.errors import RequestError
from tabulon.operators.grid import grid_of
from tabulon.plans import reports

DAYS = [f"{d:02d}-04-2026" for d in range(1, 8)]
PAGES = [("p", 1, "Cover"), ("p", 2, "ENERGY CONSUMPTION (MU)"), ("p", 3, "Maximum Demand met (MW)"), ("q", 1, "nothing here")]


def pages_of(spark, rows=PAGES):
    return spark.createDataFrame(rows, "doc_id string, page int, text string")


def grids_of(spark):
    energy = [["title"] + [None] * 8, ["क्षेत्र Region", "State", *DAYS], ["NR", "पंजाब Punjab", *map(str, range(1, 8))], [None, "Goa", *["1,000.5"] * 7], ["ALL INDIA", None, *map(str, range(1000, 1007))]]
    metrics = ["Max. Demand Met during the day", "Peak hr Shortage"] * 7
    demand = [["title"] + [None] * 15, ["Region", "State", *[x for d in DAYS for x in (d, None)]], [None, None, *metrics], ["x", "Punjab", *["7517", "0"] * 7], ["ALL INDIA", "", *["9000", "5"] * 7]]
    return grid_of(spark, energy, "p", 2).unionByName(grid_of(spark, demand, "p", 3))


def test_both_tables_of_the_power_report(spark):
    out = reports.process(pages_of(spark), grids_of(spark), "p")
    assert list(out) == ["energy_consumption.clean", "energy_consumption.long", "maximum_demand.clean", "maximum_demand.long"]
    rows = [tuple(r)[1:] for r in out["energy_consumption.long"].orderBy("row_pos").collect()]
    day = datetime.date(2026, 4, 1)
    assert len(rows) == 21
    assert rows[:3] == [("NR", "Punjab", day, 1.0), ("WR", "Goa", day, 1000.5), ("ALL INDIA", "ALL INDIA", day, 1000.0)]
    rows = [tuple(r)[1:] for r in out["maximum_demand.long"].orderBy("row_pos").collect()]
    assert len(rows) == 14 and rows[:2] == [("NR", "Punjab", day, 7517, 0), ("ALL INDIA", "ALL INDIA", day, 9000, 5)]
    assert out["maximum_demand.clean"].columns[3] == "01-04-2026 | Max. Demand Met during the day"


def test_unknown_and_ambiguous_documents(spark):
    other = reports.Report("other", ("cover",), reports.POWER.tables)
    found = {r["doc_id"]: (r["report"], r["status"]) for r in reports.detect(pages_of(spark)).collect()}
    assert found == {"p": ("weekly_power_report", "known"), "q": (None, "unknown")}
    both = {r["doc_id"]: r["status"] for r in reports.detect(pages_of(spark), (reports.POWER, other)).collect()}
    assert both["p"] == "ambiguous"
    with pytest.raises(RequestError):
        reports.process(pages_of(spark), grids_of(spark), "q")


def test_places_of_tables(spark):
    pages = pages_of(spark, [("a", 1, "Start end"), ("a", 2, None), ("a", 3, "END"), ("a", 4, "start"), ("b", 1, "start")])

    def places(**more):
        return {tuple(r) for r in reports.locate(pages, reports.ReportTable("t", ("start",), dict, **more)).collect()}

    assert places() == {("a", 1, 1), ("b", 1, 1)}
    assert places(match=1) == {("a", 4, 4)}
    assert places(ends=("end",)) == {("a", 1, 2)}
    assert places(ends=("end",), with_end=True) == {("a", 1, 3)}
    assert places(ends=("end",), match=1) == set()


def test_wrong_reports_and_cells(spark):
    with pytest.raises(RequestError):
        reports.ReportTable("t", (), dict)
    with pytest.raises(RequestError):
        reports.ReportTable("t", ("x",), dict, with_end=True)
    rows = [["t"] + [None] * 8, ["Region", "State", *DAYS], ["NR", "Atlantis", *["1"] * 7]]
    with pytest.raises(RequestError):  # no region for it
        reports.energy(grid_of(spark, rows))
    rows[2] = ["NR", "Goa", "n/a", *["1"] * 6]
    long = reports.energy(grid_of(spark, rows))["long"]
    with pytest.raises(RequestError):
        long.contract.check(long.rows)
