"""Registered queries over the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import generic, quality, reshape
from .plans.engine import Engine, Table
from .plans.language import Catalog, Dimension, Metric, QuestionEngine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def request(name: str, body: dict, sql: str, order: tuple[str, ...] = ()) -> None:
    """Register a request over a plain table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine({body["table"]: Table(table(spark, sf_dir, body["table"]), order)}).compile(body).answer

    QUERIES[name], ORACLE[name] = run, sql


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels, null where there are none."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "lang", "source", "n_chars", "quality")


LABELLED = "(SELECT d.doc_id, lang, source, n_chars, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def on_labelled(name: str, body: dict, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine({"labelled": Table(labelled(spark, sf_dir), ("doc_id",))}).compile(body | {"table": "labelled"}).answer

    QUERIES[name], ORACLE[name] = run, sql.replace("labelled", LABELLED)


request(
    "flagship",
    {"table": "orders", "filters": [{"column": "o_orderstatus", "operator": "ne", "value": "P"}], "group_by": ["o_orderpriority"], "aggregations": [{"column": "o_totalprice", "operation": "sum", "alias": "total_price"}], "order_by": [{"column": "total_price", "direction": "desc"}], "limit": 5},
    "SELECT o_orderpriority, sum(o_totalprice) AS total_price FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 ORDER BY 2 DESC LIMIT 5",
)

for _op, _sql in (("eq", "="), ("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    request(
        f"filter_{_op}",
        {"table": "lineitem", "filters": [{"column": "l_quantity", "operator": _op, "value": 25}], "group_by": ["l_returnflag"], "aggregations": [{"column": "l_orderkey", "operation": "count", "alias": "n"}]},
        f"SELECT l_returnflag, count(l_orderkey) AS n FROM lineitem WHERE l_quantity {_sql} 25 GROUP BY 1",
    )
on_labelled("filter_ne_null_kept", {"filters": [{"column": "quality", "operator": "ne", "value": 1}], "group_by": ["lang"], "aggregations": [{"column": "doc_id", "operation": "count", "alias": "n"}]}, "SELECT lang, count(doc_id) AS n FROM labelled WHERE quality IS DISTINCT FROM 1 GROUP BY 1")
on_labelled("filter_not_in_null_kept", {"filters": [{"column": "quality", "operator": "not_in", "value": [1]}], "group_by": ["lang"], "aggregations": [{"column": "doc_id", "operation": "count", "alias": "n"}]}, "SELECT lang, count(doc_id) AS n FROM labelled WHERE NOT coalesce(quality IN (1), false) GROUP BY 1")
on_labelled("filter_is_null", {"filters": [{"column": "quality", "operator": "eq", "value": None}], "aggregations": [{"column": "doc_id", "operation": "count", "alias": "n"}]}, "SELECT count(doc_id) AS n FROM labelled WHERE quality IS NULL")
on_labelled("filter_is_not_null", {"filters": [{"column": "quality", "operator": "ne", "value": None}], "aggregations": [{"column": "doc_id", "operation": "count", "alias": "n"}]}, "SELECT count(doc_id) AS n FROM labelled WHERE quality IS NOT NULL")
request("filter_in", {"table": "orders", "filters": [{"column": "o_orderstatus", "operator": "in", "value": ["O", "F"]}], "group_by": ["o_orderstatus"], "aggregations": [{"column": "o_orderkey", "operation": "count", "alias": "n"}]}, "SELECT o_orderstatus, count(o_orderkey) AS n FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY 1")
request("filter_not_in", {"table": "orders", "filters": [{"column": "o_orderstatus", "operator": "not_in", "value": ["O", "F"]}], "group_by": ["o_orderstatus"], "aggregations": [{"column": "o_orderkey", "operation": "count", "alias": "n"}]}, "SELECT o_orderstatus, count(o_orderkey) AS n FROM orders WHERE o_orderstatus NOT IN ('O', 'F') GROUP BY 1")
request("filter_between_date", {"table": "orders", "filters": [{"column": "o_orderdate", "operator": "between", "value": ["1995-01-01", "1995-12-31"]}], "group_by": ["o_orderpriority"], "aggregations": [{"column": "o_orderkey", "operation": "count", "alias": "n"}]}, "SELECT o_orderpriority, count(o_orderkey) AS n FROM orders WHERE o_orderdate BETWEEN timestamp '1995-01-01' AND timestamp '1995-12-31' GROUP BY 1")
request("filter_contains", {"table": "documents", "filters": [{"column": "text", "operator": "contains", "value": "the"}], "group_by": ["lang"], "aggregations": [{"column": "doc_id", "operation": "count", "alias": "n"}]}, "SELECT lang, count(doc_id) AS n FROM documents WHERE contains(text, 'the') GROUP BY 1")
request("project_columns", {"table": "part", "columns": ["p_name", "p_partkey"], "order_by": [{"column": "p_partkey"}], "limit": 50}, "SELECT p_name, p_partkey FROM part ORDER BY p_partkey LIMIT 50")
request(
    "agg_scalar_all",
    {"table": "lineitem", "aggregations": [{"column": "l_linenumber", "operation": "sum", "alias": "s"}, {"column": "l_quantity", "operation": "mean", "alias": "m"}, {"column": "l_quantity", "operation": "median", "alias": "md"}, {"column": "l_shipdate", "operation": "min", "alias": "lo"}, {"column": "l_shipdate", "operation": "max", "alias": "hi"}, {"column": "l_tax", "operation": "count", "alias": "n"}, {"column": "l_suppkey", "operation": "nunique", "alias": "u"}]},
    "SELECT CAST(sum(l_linenumber) AS BIGINT) AS s, avg(l_quantity) AS m, median(l_quantity) AS md, min(l_shipdate) AS lo, max(l_shipdate) AS hi, count(l_tax) AS n, count(DISTINCT l_suppkey) AS u FROM lineitem",
)
request("agg_group_median_nunique", {"table": "events", "group_by": ["event_type"], "aggregations": [{"column": "value", "operation": "median", "alias": "md"}, {"column": "user_id", "operation": "nunique", "alias": "u"}], "order_by": [{"column": "u", "direction": "desc"}, {"column": "event_type"}]}, "SELECT event_type, median(value) AS md, count(DISTINCT user_id) AS u FROM events GROUP BY 1")
on_labelled("agg_null_group_key", {"group_by": ["quality"], "aggregations": [{"column": "n_chars", "operation": "sum", "alias": "chars"}, {"column": "quality", "operation": "sum", "alias": "q"}]}, "SELECT quality, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(coalesce(sum(quality), 0) AS BIGINT) AS q FROM labelled GROUP BY 1")
request("top_k_count", {"table": "lineitem", "group_by": ["l_suppkey"], "aggregations": [{"column": "l_orderkey", "operation": "nunique", "alias": "n_orders"}], "order_by": [{"column": "n_orders", "direction": "desc"}, {"column": "l_suppkey"}], "limit": 10}, "SELECT l_suppkey, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
for _dir in ("asc", "desc"):
    on_labelled(f"sort_nulls_last_{_dir}", {"columns": ["doc_id", "quality"], "order_by": [{"column": "quality", "direction": _dir}], "limit": 500}, f"SELECT doc_id, quality FROM labelled ORDER BY quality {_dir} NULLS LAST, doc_id LIMIT 500")

CATALOG = Catalog((
    Metric("order price", "orders", "o_totalprice", ("order price", "order value", "revenue"), ("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate", "o_totalprice"), (Dimension("o_orderstatus", ("status", "statuses")), Dimension("o_orderpriority", ("priority", "priorities"))), "sum", "o_orderdate"),
    Metric("event value", "events", "value", ("event value", "amount"), ("event_id", "event_type", "ts", "value"), (Dimension("event_type", ("type", "types", "event type")),), "mean", "ts", (("event_type", "view"),)),
))


def question(name: str, asked: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = {"orders": Table(table(spark, sf_dir, "orders"), ("o_orderkey",)), "events": Table(table(spark, sf_dir, "events"), ("event_id",))}
        return QuestionEngine(CATALOG, tables).ask(asked)[1].answer

    QUERIES[name], ORACLE[name] = run, sql


question("nl_top_priorities", "Show the top 5 priorities by order price", 'SELECT o_orderpriority, sum(o_totalprice) AS "Total_o_totalprice" FROM orders GROUP BY 1 ORDER BY 2 DESC LIMIT 5')
question("nl_which_highest", "Which priority had the highest revenue?", 'SELECT o_orderpriority, sum(o_totalprice) AS "Total_o_totalprice" FROM orders GROUP BY 1 ORDER BY 2 DESC LIMIT 1')
question("nl_average_by", "What is the average order price by status?", 'SELECT o_orderstatus, avg(o_totalprice) AS "Average_o_totalprice" FROM orders GROUP BY 1')
question("nl_date_range", "Maximum order value by priority from 1995-01-01 to 31-12-1995", """SELECT o_orderpriority, max(o_totalprice) AS "Maximum_o_totalprice" FROM orders WHERE o_orderdate BETWEEN timestamp '1995-01-01' AND timestamp '1995-12-31' GROUP BY 1""")
question("nl_total_excluded", "Average amount by event type", """SELECT event_type, avg(value) AS "Average_value" FROM events WHERE event_type IS DISTINCT FROM 'view' GROUP BY 1""")


@query("SELECT p_partkey, p_name AS name, p_size FROM part")
def rename_drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generic.correct_columns(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_retailprice"], {"p_name": "name", "p_size": ""})


@query("SELECT s_suppkey, variable, value FROM (SELECT s_suppkey, s_nationkey * 1.0::DOUBLE AS nation, s_acctbal AS balance FROM supplier) UNPIVOT (value FOR variable IN (nation, balance))")
def melt_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return reshape.melt(wide, ["s_suppkey"], "value", "variable", date_format=None).drop("measure_pos")


@query("""SELECT p_partkey, date '2026-03-30' AS "Date", CAST(p_size AS BIGINT) AS size, CAST(p_partkey % 7 AS BIGINT) AS rest FROM part
UNION ALL SELECT p_partkey, date '2026-03-31', CAST(p_size + 1 AS BIGINT), CAST(p_partkey % 5 AS BIGINT) FROM part""")
def paired_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    wide = table(spark, sf_dir, "part").select("p_partkey", size.alias("a"), (key % 7).alias("b"), (size + 1).alias("c"), (key % 5).alias("d"))
    headers = {"a": ("30-03-2026", "Size"), "b": ("30-03-2026", "Rest"), "c": ("31-03-2026", "Size"), "d": ("31-03-2026", "Rest")}
    return reshape.paired_melt(wide, {"p_partkey": "p_partkey"}, headers, {"Size": "size", "Rest": "rest"}).drop("date_pos")


@query("""WITH parts AS (SELECT l_orderkey AS k, sum(l_linenumber) AS s FROM lineitem GROUP BY 1)
SELECT k AS o_orderkey, CAST(s AS DOUBLE) AS component_sum, 10.0::DOUBLE AS reported_total, 1::BIGINT AS reported_rows, 10.0::DOUBLE - s AS difference, abs(10.0::DOUBLE - s) <= 3 AS within_tolerance FROM parts""")
def reconcile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("double").alias("v"), F.lit("part").alias("kind"))
    totals = lines.select("o_orderkey", F.lit(10.0).alias("v"), F.lit("total").alias("kind")).distinct()
    return reshape.reconcile(lines.unionByName(totals), "v", "o_orderkey", F.col("kind") == "total", 3.0)


@query("SELECT n_nationkey, n_name, n_regionkey, 'R' || (n_nationkey % 5) AS region FROM nation")
def map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").limit(1000).collect()
    return reshape.assign_from_mapping(table(spark, sf_dir, "nation").withColumn("region", F.lit(None).cast("string")), "n_name", "region", {r["n_name"]: f"R{r['n_nationkey'] % 5}" for r in names})


@query("SELECT n_name AS key FROM nation WHERE n_name NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0)")
def unmapped_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    even = {r["n_name"]: "x" for r in nation.where("n_nationkey % 2 = 0").limit(1000).collect()}
    return reshape.unmapped_keys(nation, "n_name", even, "n_nationkey")


@query("SELECT event_id, last_value(CASE WHEN event_type <> 'view' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS event_type FROM events")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.grid import forward_fill as fill

    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") != "view", F.col("event_type")).otherwise(" ").alias("event_type"))
    return fill(events, ["event_type"], "event_id", ["user_id"]).select("event_id", "event_type")


@query("""WITH i AS (SELECT *, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM events)
SELECT CAST(user_id AS VARCHAR) AS user_id, min(event_id) AS first_event, CAST(min(event_id) AS VARCHAR) AS first_cell, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY event_id) AS comments FROM i WHERE g > 0 GROUP BY user_id, g""")
def record_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.grid import stitch_records

    cells = F.array("event_type", F.col("event_id").cast("string"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("table_index"), F.col("event_id").alias("row_pos"), cells.alias("cells"))
    records = stitch_records(rows, "^click$", F.array(F.col("cells")[1]), 1)
    return records.select(F.col("doc_id").alias("user_id"), F.col("row_pos").alias("first_event"), F.col("fields")[0].alias("first_cell"), "comments")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n > 1")
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generic.duplicate_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1")
def duplicate_keys_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generic.duplicate_keys(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"]).select("doc_id")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("url").alias("doc_id"), F.col("page_id").alias("page"), F.col("html").alias("text"))


@query("SELECT page_id AS page FROM pages WHERE contains(lower(html), 'the')")
def page_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.pages import search

    return search(_pages(spark, sf_dir), "The").select("page")


@query("SELECT page_id AS page FROM pages WHERE contains(lower(html), 'the') AND contains(lower(html), 'and')")
def page_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.pages import search_all

    return search_all(_pages(spark, sf_dir), ["the", "and"]).select("page")


@query("SELECT page_id AS page FROM pages WHERE NOT contains(lower(html), 'the')")
def anti_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.pages import search, without_tables

    pages = _pages(spark, sf_dir)
    return without_tables(pages, search(pages, "the")).select("page")


@query("SELECT doc_id, trim(regexp_replace(text, '[\\s\\p{Z}\\x{85}]+', ' ', 'g')) AS text FROM documents")
def collapse_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.collapse(F.col("text")).alias("text"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN p_size / 100.0::DOUBLE ELSE p_size * 1000.0::DOUBLE END AS v FROM part")
def numeric_inference_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(key % 10 == 0, "n/a").when(key % 2 == 0, F.concat(size, F.lit("%"))).otherwise(F.concat(size, F.lit(",000")))
    return generic.infer_numbers(table(spark, sf_dir, "part").select("p_partkey", text.alias("v")))[0].select("p_partkey", F.col("v").cast("double").alias("v"))


@query("SELECT o_orderkey, o_orderkey % 4 <> 3 AS is_date, o_orderkey % 4 = 3 AS is_number FROM orders")
def date_number_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(key % 4 == 0, F.date_format(day, "d-M-yyyy")).when(key % 4 == 1, F.date_format(day, "yyyy/MM/dd")).when(key % 4 == 2, F.date_format(day, "d MMM yyyy")).otherwise(F.format_number("o_totalprice", 2))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))
    return rows.select("o_orderkey", X.is_date_like(F.col("t")).alias("is_date"), X.is_number_like(F.col("t")).alias("is_number"))


@query(f"SELECT count(*) AS n_rows, count(*) - count(quality) AS missing_quality, count(*) - count(lang) AS missing_lang FROM {LABELLED}")
def missing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    n = quality.missing_by_column(rows, "doc_id")
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(n["quality"]).cast("long").alias("missing_quality"), F.lit(n["lang"]).cast("long").alias("missing_lang"))


@query(f"SELECT doc_id AS row_pos, CAST(CASE WHEN quality IS NULL THEN 1 ELSE 0 END AS INTEGER) AS n_missing FROM {LABELLED}")
def missing_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missing_by_row(labelled(spark, sf_dir).withColumnRenamed("doc_id", "row_pos"))


@query(f"""SELECT '5 columns instead of 4' AS violation UNION ALL SELECT 'column ''title'' is missing'
UNION ALL SELECT n || ' missing cells in ''quality''' FROM (SELECT count(*) - count(quality) AS n FROM {LABELLED}) WHERE n > 0
UNION ALL SELECT n || ' rows share a key of lang' FROM (SELECT count(*) AS n FROM (SELECT count(*) OVER (PARTITION BY lang) AS k FROM documents) WHERE k > 1) WHERE n > 0""")
def schema_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    contract = quality.Contract(column_count=4, required=("title",), filled=("quality", "n_chars"), unique_key=("lang",))
    found = contract.violations(labelled(spark, sf_dir), "row_pos")
    return spark.createDataFrame([(v,) for v in found], "violation string")


@query('SELECT event_type AS "Category", max(value) AS "Value" FROM events WHERE value IS NOT NULL GROUP BY 1 ORDER BY min(event_id) LIMIT 50')
def chart_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generic.chart_data(table(spark, sf_dir, "events"), "event_type", "value", "max", order="event_id")


@query("""SELECT CAST(row_number() OVER (ORDER BY page, place) - 1 AS INTEGER) AS row_pos, name, region FROM (
SELECT 1 AS page, r_regionkey AS place, r_name AS name, NULL::VARCHAR AS region FROM region UNION ALL SELECT 2, n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) FROM nation)""")
def union_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.grid import span

    def page(name: str, at: str, number: int, *cells: str) -> DataFrame:
        texts = F.array(*(F.col(c).cast("string") for c in cells))
        return table(spark, sf_dir, name).select(F.lit("places").alias("doc_id"), F.lit(number).alias("page"), F.lit(0).alias("table_index"), F.col(at).cast("int").alias("row_pos"), texts.alias("cells"))

    rows = span(page("region", "r_regionkey", 1, "r_name").unionByName(page("nation", "n_nationkey", 2, "n_name", "n_regionkey")), "places", [1, 2])
    return rows.select("row_pos", F.col("cells")[0].alias("name"), F.col("cells")[1].alias("region"))
