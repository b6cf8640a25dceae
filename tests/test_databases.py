"""Reads and scans over JDBC, against an embedded database."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from tablewarden.plans.databases import database
from tablewarden.sources import databases, files


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def db(spark):
    c = database(spark)
    rows = spark.range(0, 3000).selectExpr("if(id % 500 = 7, null, id) as k", "concat('name ', id) as name", "id % 3 as g", "cast(id as double) / 7 as v", "timestamp_ntz '2024-01-01 10:00:00' as at")
    databases.save_table(rows, c, "t")
    databases.save_table(rows.where("false"), c, "empty")
    databases.save_table(rows.where("k < 5"), c, "Odd.na\"me".replace(".", "_"))
    return c


def test_a_table_is_read_in_ranges_of_its_key(spark, db):
    df = databases.whole_table(spark, db, "t", "k", rows_a_task=700)
    assert df.rdd.getNumPartitions() == 5 and dict(df.dtypes)["at"] == "timestamp_ntz"
    assert df.count() == 3000 and df.where("k is null").count() == 6 and df.select("name").distinct().count() == 3000
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 5 and max(sizes) < 700
    assert databases.whole_table(spark, db, "t", "k", rows_a_task=700, connections=2).rdd.getNumPartitions() == 2
    assert databases.whole_table(spark, db, "t").rdd.getNumPartitions() == 1
    assert databases.whole_table(spark, db, "empty", "k", rows_a_task=1).count() == 0


def test_filters_and_columns_reach_the_database(spark, db):
    text = plan(databases.whole_table(spark, db, "t", "k", rows_a_task=700).where("g = 1").select("v"))
    assert "EqualTo(g,1)" in text and "ReadSchema: struct<v:double>" in text


def test_limits_reach_the_database(spark, db):
    df = databases.first_rows(spark, db, "t", 10)
    assert df.count() == 10 and "FETCH FIRST 10 ROWS ONLY" in plan(df)
    asked = databases.read_query(spark, db, 'select "k", "v" from "t" where "g" = 2;', 20)
    assert asked.count() == 20 and "FETCH FIRST 20 ROWS ONLY" in plan(asked)
    assert databases.first_rows(spark, db, 'Odd_na"me', 0).count() == 1


def test_aggregates_of_an_attached_database_run_there(spark, db):
    name = databases.attach(spark, db, "attached_t")
    df = spark.table(f"{name}.APP.t").where("v > 1").groupBy("g").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    text = plan(df)
    assert "PushedAggregates: [COUNT(*), MAX(v)]" in text and "GROUP BY" in text
    assert {(r["g"], r["n"]) for r in df.collect()} == {(0, 997), (1, 997), (2, 998)}


def test_one_query_that_reads(spark, db):
    for bad in ('drop table "t"', "select 1; drop table x", "select ';' ; delete from t", "/* select */ update t set a = 1"):
        with pytest.raises(ValueError):
            databases.read_query(spark, db, bad)
    assert databases.read_query(spark, db, "select ';' as a, 1 as b /* ; */ from \"t\" -- ;\n where \"k\" = 3").first()[0] == ";"


def test_many_databases_at_once(spark, db):
    late = lambda: spark.range(3).select(F.lit("t").alias("table"), F.raise_error(F.lit("lost")).cast("string").alias("column"), F.lit("x").alias("type"))
    fine = lambda: databases.catalogue(spark, db)
    gone = lambda: spark.read.format("jdbc").options(url="jdbc:derby:memory:gone", query="select 1 from sysibm.sysdummy1").load()
    got = files.scan_sources(spark, {k: {"name": k.upper(), "engine": "x", "catalog": f} for k, f in (("late", late), ("fine", fine), ("gone", gone))}).collect()
    assert {r["conn_id"] for r in got if r["error"]} == {"late", "gone"}
    assert all(len(r["error"]) <= 255 for r in got if r["error"])
    assert {(r["table"], r["column"]) for r in got if r["conn_id"] == "fine"} == {(t, c) for t in ("t", "empty", 'Odd_na"me') for c in ("k", "name", "g", "v", "at")}
    assert files.scan_sources(spark, {}).count() == 0
    none = databases.scan(spark, [databases.Connection("n", "none", "jdbc:derby:memory:fresh;create=true")]).collect()
    assert [tuple(r) for r in none] == [("n", "none", "derby", None, None, None, None)]


def test_names_in_each_engine(spark, monkeypatch):
    rows = spark.createDataFrame([("public", "a", "x", "int", 1), ("sales", "b", "y", "text", 1), ("pg_catalog", "c", "z", "text", 1)], "s string, t string, c string, d string, p int")

    class Fake:
        def option(self, *_):
            return self

        def load(self):
            return rows

    monkeypatch.setattr(databases, "reader", lambda *_: Fake())
    name = lambda url, **k: sorted(r["table"] for r in databases.catalogue(spark, databases.Connection("c", "c", url, **k)).collect())
    assert name("jdbc:postgresql://h/d") == ["a", "sales.b"]
    assert name("jdbc:mysql://h/d") == ["a", "b"]
    assert name("jdbc:sqlserver://h", schema="sales") == ["b", "public.a"]
