"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = E.queries(), E.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (bool, str)) or type(v).__name__ == "bool":
        return str(v)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return f"{float(v):.9g}"


def rows(df):
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
@pytest.mark.parametrize("name", ["status_updates", "case_timeline", "webhook_pending", "first_author", "usage_monthly"])
def test_times_do_not_depend_on_the_session_zone(spark, duck, name, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert rows(QUERIES[name](spark, DIR).toPandas()) == rows(duck.execute(SQL[name]).df())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_timeline_of_items_at_one_time(spark, tmp_path):
    """Items of one number and time, as a table of repeated keys has them, get the same places however the rows stand."""
    d = "timestamp '1996-03-01 00:00:00'"
    spark.sql(f"SELECT 1L AS o_orderkey, {d} AS o_orderdate, '1-URGENT' AS o_orderpriority").write.parquet(f"{tmp_path}/a/orders.parquet")
    spark.read.parquet(f"{tmp_path}/a/orders.parquet").write.parquet(f"{tmp_path}/b/orders.parquet")
    for at, flags in (("a", ("'R'", "'N'")), ("b", ("'N'", "'R'"))):
        spark.sql(" UNION ALL ".join(f"SELECT 1L AS l_orderkey, 3 AS l_linenumber, {d} AS l_shipdate, {x} AS l_returnflag" for x in flags)).coalesce(1).write.parquet(f"{tmp_path}/{at}/lineitem.parquet")
    a, b = (sorted(map(tuple, QUERIES["case_timeline"](spark, f"{tmp_path}/{at}").collect())) for at in "ab")
    assert a == b and [(r[2], r[4]) for r in sorted(a, key=lambda r: r[4])] == [("opened", 1), ("returned", 2), ("shipped", 3), ("closed", 4)]


def test_entry(spark):
    assert E.entry(spark).columns == ["id_a", "id_b", "copies_a", "copies_b", "score", "risk"]
