"""Requests and questions on the books of a small harbour: ships that land fish at piers."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from tabulon.errors import AmbiguousQuestion, NoMatchingRows, RequestError, UnknownColumn, UnknownTable, UnsupportedQuestion
from tabulon.plans.engine import Engine, Table
from tabulon.plans.language import Catalog, Dimension, Metric, QuestionEngine, generic_aliases, generic_catalog, preferred_category, question_examples, scan, tokens
from tabulon.plans.request import FILTERS, Aggregation, Filter, Order, Request, parse_request

LANDINGS = "id long, pier string, fish string, landed date, kilos double, boxes long, seen timestamp"


def landing(i):
    pier, fish = ("North", "South", "East", None)[i % 4], ("cod", "eel", "crab")[i % 3]
    kilos = (None, float("nan"))[i // 11 % 2] if i % 11 == 5 else i * 1.5
    return i, pier, fish, dt.date(2025, 5, 1 + i % 28), kilos, i % 7, dt.datetime(2025, 5, 1 + i % 28, i % 24)


ROWS = [landing(i) for i in range(60)]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "landings")
    spark.createDataFrame(ROWS, LANDINGS).write.parquet(path)
    return Engine({"landings": Table(spark.read.parquet(path), ("id",))})


def known(v):
    return v is not None and v == v


#: What each operator means, cell by cell.
MEANING = {
    "eq": lambda c, v: known(c) and c == v, "ne": lambda c, v: not known(c) or c != v, "gt": lambda c, v: known(c) and c > v, "gte": lambda c, v: known(c) and c >= v,
    "lt": lambda c, v: known(c) and c < v, "lte": lambda c, v: known(c) and c <= v, "in": lambda c, v: known(c) and c in v, "not_in": lambda c, v: not known(c) or c not in v,
    "between": lambda c, v: known(c) and v[0] <= c <= v[1], "contains": lambda c, v: known(c) and v in str(c),
}
VALUES = {"pier": ("North", ["North", "East"], ["East", "North"], "t"), "kilos": (30.0, [30.0, 45.0], [20.0, 60.0], "3"), "boxes": (3, [3, 5], [2, 4], "3"), "landed": ("2025-05-09", ["2025-05-09", "2025-05-20"], ["2025-05-09", "2025-05-20"], "05-1")}


@pytest.mark.parametrize(("column", "operator"), [*itertools.product(VALUES, FILTERS)])
def test_filters_mean_what_they_say_and_reach_the_scan(engine, column, operator):
    one, some, pair, text = VALUES[column]
    value = {"in": some, "not_in": some, "between": pair, "contains": text}.get(operator, one)
    result = engine.compile({"table": "landings", "columns": ["id"], "filters": [{"column": column, "operator": operator, "value": value}], "limit": 1000})
    at = ["id", "pier", "fish", "landed", "kilos", "boxes"].index(column)
    plain = (lambda v: dt.date.fromisoformat(v)) if column == "landed" and operator != "contains" else lambda v: v
    want = [r[0] for r in ROWS if MEANING[operator](r[at], [plain(v) for v in value] if isinstance(value, list) else plain(value))]
    assert [r["id"] for r in result.rows()] == want
    plan = result.answer._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters: [") :].split("]")[0]
    if operator != "contains" or column == "pier":
        assert column in pushed


def test_times_are_pushed_down_too(engine):
    result = engine.compile({"table": "landings", "columns": ["id"], "filters": [{"column": "seen", "operator": "gte", "value": "2025-05-20 03:00:00"}], "limit": 1000})
    assert [r["id"] for r in result.rows()] == [r[0] for r in ROWS if r[6] >= dt.datetime(2025, 5, 20, 3)]
    assert "GreaterThanOrEqual(seen" in result.answer._jdf.queryExecution().executedPlan().toString()


def test_groups_order_and_evidence(engine):
    result = engine.compile(Request("landings", filters=(Filter("fish", "eq", "eel"),), group_by=("pier",), aggregations=(Aggregation("kilos", "sum", "all"), Aggregation("id", "count")), order_by=(Order("all", "desc"),), limit=2))
    want = {}
    for r in ROWS:
        if r[2] == "eel":
            want.setdefault(r[1], []).append(r[4] if known(r[4]) else 0.0)
    best = sorted(want.items(), key=lambda x: -sum(x[1]))[:2]
    assert [tuple(r) for r in result.rows()] == [(p, sum(v), len(v)) for p, v in best]
    assert result.counts() == {"source_row_count": 60, "matched_row_count": 20, "returned_row_count": 2}
    assert [r["id"] for r in result.evidence(3).collect()] == [1, 4, 7]


def test_every_aggregation_leaves_missing_cells_out(engine):
    cells = [r[4] for r in ROWS if known(r[4])]
    ops = ("sum", "mean", "median", "min", "max", "count", "nunique")
    got = engine.ask({"table": "landings", "aggregations": [{"column": "kilos", "operation": o, "alias": o} for o in ops]})[0]
    middle = sorted(cells)[len(cells) // 2 - 1 : len(cells) // 2 + 1]
    median = sum(middle) / 2 if len(cells) % 2 == 0 else sorted(cells)[len(cells) // 2]
    assert got.asDict() == pytest.approx({"sum": sum(cells), "mean": sum(cells) / len(cells), "median": median, "min": min(cells), "max": max(cells), "count": len(cells), "nunique": len(set(cells))})


@pytest.mark.parametrize("way", ["asc", "desc"])
def test_missing_cells_come_last(engine, way):
    got = [r["kilos"] for r in engine.ask({"table": "landings", "columns": ["kilos"], "order_by": [{"column": "kilos", "direction": way}]})]
    cells = sorted((r[4] for r in ROWS if known(r[4])), reverse=way == "desc")
    assert got == cells + [None] * (60 - len(cells))


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({"table": "sales"}, UnknownTable), ({"columns": ["weight"]}, UnknownColumn), ({"filters": [{"column": "fish", "operator": "eq", "value": "tuna"}]}, NoMatchingRows),
        ({"aggregations": [{"column": "pier", "operation": "median"}]}, RequestError), ({"columns": ["pier"], "order_by": [{"column": "kilos"}]}, UnknownColumn),
        ({"filters": [{"column": "fish", "operator": "lt", "value": 4}]}, RequestError), ({"filters": [{"column": "landed", "operator": "eq", "value": "soon"}]}, RequestError),
    ],
)
def test_requests_that_cannot_be_run(engine, change, error):
    with pytest.raises(error):
        engine.ask({"table": "landings"} | change)


@pytest.mark.parametrize(
    "change",
    [
        {"table": ""}, {"where": []}, {"limit": 0}, {"limit": 1001}, {"limit": 2.0}, {"limit": False}, {"columns": "pier"}, {"columns": ["a", "a"]}, {"group_by": ["pier"]},
        {"columns": ["pier"], "aggregations": [{"column": "kilos", "operation": "sum"}]}, {"group_by": ["pier"], "aggregations": [{"column": "kilos", "operation": "sum", "alias": "pier"}]},
        {"filters": [{"column": "pier", "operator": "like", "value": "N"}]}, {"filters": [{"column": "pier", "operator": "eq"}]}, {"filters": [{"column": "pier", "operator": "in", "value": "N"}]},
        {"filters": [{"column": "pier", "operator": "in", "value": []}]}, {"filters": [{"column": "kilos", "operator": "between", "value": [1, 2, 3]}]}, {"filters": [{"column": "pier", "operator": "eq", "value": ["N"]}]},
        {"filters": [{"column": "pier", "operator": "contains", "value": 1}]}, {"filters": ["pier"]}, {"order_by": [{"column": "pier", "direction": "up"}]}, {"aggregations": [{"operation": "sum"}]},
    ],
)
def test_rejected_requests(change):
    with pytest.raises((TypeError, ValueError)):
        parse_request({"table": "landings"} | change)


def test_requests_survive_a_round_trip():
    asked = parse_request('{"table": " landings ", "aggregations": [{"column": "kilos", "operation": "MAX"}], "filters": [{"column": "pier", "operator": "in", "value": ["a", null]}]}')
    assert (asked.table, asked.limit, asked.aggregations[0].alias, asked.filters[0].value) == ("landings", 100, "max_kilos", ("a", None))
    assert parse_request(asked.to_dict()) == asked
    with pytest.raises(ValueError):
        parse_request("{")
    with pytest.raises(TypeError):
        parse_request("[]")


PIER, FISH = Dimension("pier", ("pier", "piers")), Dimension("fish", ("fish", "kind"))
HARBOUR = Catalog((
    Metric("catch", "landings", "kilos", ("catch", "landed weight"), ("pier", "fish", "landed", "kilos"), (PIER, FISH), "sum", "landed", (("pier", "East"),)),
    Metric("box count", "landings", "boxes", ("boxes", "box count"), ("pier", "fish", "landed", "boxes"), (PIER, FISH), "max", "landed"),
    Metric("hours", "landings", "id", ("hours", "weight"), ("fish", "id"), (FISH,), "mean"),
))


@pytest.fixture(scope="module")
def harbour(engine):
    return QuestionEngine(HARBOUR, {"landings": engine.tables["landings"]})


def test_phrases_are_found_between_words():
    assert [(m.value, m.start) for m in scan(tokens("the odd cod_oil cod"), {("cod",): [("x", 1)], ("odd", " ", "cod"): [("x", 2)]})] == [(2, 2), (1, 4), (1, 8)]


@pytest.mark.parametrize(
    ("asked", "groups", "operation", "order", "limit"),
    [
        ("Which pier had the highest catch?", ("pier",), "sum", "desc", 1), ("Top 2 fish by catch", ("fish",), "sum", "desc", 2), ("avg boxes per kind", ("fish",), "mean", "desc", 100),
        ("What is the highest catch?", (), "sum", "desc", 100), ("median landed weight by the pier", ("pier",), "median", "desc", 100), ("total catch", (), "sum", None, 100),
        ("Which fish had the fewest boxes?", ("fish",), "max", "asc", 1), ("Compare the average catch of North and South", ("pier",), "mean", "desc", 100),
    ],
)
def test_questions_that_add_up(harbour, asked, groups, operation, order, limit):
    request = harbour.interpret(asked).request
    assert (request.group_by, request.aggregations[0].operation, request.order_by[0].direction if request.order_by else None, request.limit) == (groups, operation, order, limit)
    assert harbour.engine.compile(request).rows()


def test_questions_that_show_rows(harbour):
    read, result = harbour.ask("Show the North pier's catch from 2025-05-03 to 20-05-2025")
    assert read.request.filters == (Filter("pier", "eq", "North"), Filter("landed", "between", ("2025-05-03", "2025-05-20")))
    want = [r for r in ROWS if r[1] == "North" and dt.date(2025, 5, 3) <= r[3] <= dt.date(2025, 5, 20)]
    assert result.counts()["matched_row_count"] == len(want) and result.answer.columns == ["pier", "fish", "landed", "kilos"]
    assert harbour.interpret("Compare boxes of cod and eel").request.filters == (Filter("fish", "in", ("cod", "eel")),)
    assert Filter("pier", "ne", "East") in harbour.interpret("total catch of crab").request.filters


@pytest.mark.parametrize(
    ("asked", "error"),
    [
        ("catch and boxes", AmbiguousQuestion), ("Compare catch of eel", AmbiguousQuestion), ("total average catch", AmbiguousQuestion), ("highest and lowest catch", AmbiguousQuestion),
        ("How deep is the water?", UnsupportedQuestion), ("catch from 2025-05-09 to 2025-05-02", UnsupportedQuestion), ("catch on 2025-02-30", UnsupportedQuestion),
        ("catch on 2025-05-01, 2025-05-02, 2025-05-03", AmbiguousQuestion), ("hours on 2025-05-01", UnsupportedQuestion), ("top 0 pier by catch", UnsupportedQuestion), (" ", UnsupportedQuestion),
    ],
)
def test_refused_questions(harbour, asked, error):
    with pytest.raises(error):
        harbour.interpret(asked)


def test_tables_without_a_catalog(spark):
    rows = spark.createDataFrame([("s-1", "Reef", 4, 7), ("s-2", "Reef", 1, 9), ("s-3", "Bay", 6, 1)], "`Serial No` string, `Region of dive` string, `Dives` long, `No. of Dives` long")
    engine = QuestionEngine(generic_catalog(rows, "t"), {"t": rows})
    with pytest.raises(AmbiguousQuestion):  # both columns are called that
        engine.ask("total dives")
    single = rows.drop("Dives")
    engine = QuestionEngine(generic_catalog(single, "t"), {"t": single})
    assert engine.ask("Which region has the most dives?")[1].rows()[0].asDict() == {"Region of dive": "Reef", "Total_No. of Dives": 16}
    assert preferred_category(single.columns) == "Region of dive"
    assert question_examples(single)[0] == "What is the average No. of Dives?" and question_examples(single.select("Serial No")) == []
    assert generic_aliases("Depth | Mean value MW") == ("depth mean value mw", "mean value mw", "depth mean", "depth", "mean", "depth mean value")
    with pytest.raises(ValueError):
        generic_catalog(single.withColumn("No of dives!", F.lit(1)))


def test_plans_are_lazy(engine):
    assert engine.compile(Request("landings", columns=("pier",), filters=(Filter("boxes", "gt", 3),))).answer.columns == ["pier"]
