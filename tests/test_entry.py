import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op")}


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got, asked = entry.queries()[name](spark, SF), con.execute(SQL[name])
    names = [d[0] for d in asked.description]
    plain = lambda v: round(v, 4) if isinstance(v, float) else str(v)
    assert sorted(got.columns) == sorted(names)
    assert sorted(str([plain(r[c]) for c in names]) for r in got.collect()) == sorted(str([plain(v) for v in r]) for r in asked.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() == 5
