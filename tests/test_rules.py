"""Rules as data, checks over batches, lookups, and keys that are null or long."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewarden.operators import checks, rules
from tablewarden.plans import catalog

ROW = {"rule_id": "A", "dataset": "t", "column": "c", "dimension": "validity", "kind": "in_range", "params": {"low": "1", "high": "2.5"}}


def test_rules_go_through_a_table_and_json(spark, tmp_path):
    table = rules.rule_table(spark, catalog.RULES)
    assert rules.rules_from_table(table) == catalog.RULES
    table.write.json(str(tmp_path / "r"))
    again = spark.read.schema(rules.RULE_ROW).json(str(tmp_path / "r"))
    assert rules.rules_from_table(again) == catalog.RULES
    named = rules.compiled(catalog.BATCHED, catalog.CHECKS)
    assert rules.rules_from_table(rules.rule_table(spark, named, catalog.CHECKS), catalog.CHECKS) == named
    assert rules.rules_from_table(table.drop("params", "description", "threshold").where("kind = 'positive'"))[0].threshold == 95.0
    assert rules.rules_from_table(table.where("false")) == []


@pytest.mark.parametrize("change,fault", [
    ({"kind": "nothing"}, "unknown kind nothing"), ({"dimension": "beauty"}, "unknown dimension beauty"), ({"params": {"low": "1"}}, "no parameter high"), ({"params": {"low": "x", "high": "2"}}, "parameter low cannot be read"),
    ({"params": {"low": "1", "high": "2", "middle": "1"}}, "unknown parameter middle"), ({"threshold": 101.0}, "not between"), ({"dataset": None}, "no dataset"), ({"kind": "in_set", "params": {"values": "{}"}}, "values cannot be read"),
    ({"kind": "aggregate", "params": {"check": "none"}}, "unknown check none"), ({"kind": "lookup", "params": {"measure": "[1]", "passes": "true"}}, "measure cannot be read"),
])
def test_faults_of_rule_rows_are_named(change, fault):
    with pytest.raises(ValueError, match=fault):
        rules.compiled([ROW | change])


def test_all_faults_at_once():
    with pytest.raises(ValueError) as e:
        rules.compiled([ROW, ROW, ROW | {"rule_id": "B", "kind": "x", "dimension": "y"}])
    assert str(e.value) == "A: stands twice; B: unknown dimension y; B: unknown kind x"
    assert rules.compiled([ROW])[0].params == {"low": 1.0, "high": 2.5}


def result(spark, rule, **tables):
    r = rules.evaluate_rules(spark, [rule], tables).first()
    return r["score"], r["affected_rows"]


@pytest.mark.parametrize("null_in_reference", [False, True])
def test_null_keys_are_found_only_if_the_reference_has_null(spark, null_in_reference):
    df = spark.createDataFrame([(1,), (2,), (None,), (None,), (9,), (1,)], "k int")
    ref = spark.createDataFrame([(1,), (1,), (2,)] + [(None,)] * null_in_reference, "r int")
    rule = rules.Rule("F.1", "t", "k", "consistency", "fk", {"table": "ref", "key": "r"})
    assert result(spark, rule, t=df, ref=ref)[1] == (1 if null_in_reference else 3)
    assert result(spark, rule, t=df, ref=ref.where("false"))[1] == 6
    assert result(spark, rule, t=df.where("false"), ref=ref) == (100.0, 0)


def test_null_keys_do_not_meet_in_one_task(spark):
    df, ref = spark.range(8000).selectExpr("if(id % 3 > 0, null, id) as k"), spark.range(4000).toDF("r")
    rule = rules.Rule("F", "t", "k", "consistency", "fk", {"table": "ref", "key": "r"})
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        sizes = [r["count"] for r in rules._with_flag(df, rule, ref).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert len(sizes) == 4 and max(sizes) < 1.3 * sorted(sizes)[2]


def test_repeats_by_digest_are_repeats_by_value(spark):
    rows = [("a", 1.0, None, b"x"), ("a", 1.0, None, b"x"), ("a", -0.0, None, b""), ("a", 0.0, None, b""), (None, float("nan"), 1, None), (None, float("nan"), 1, None), ("", float("nan"), 1, None), ("-", None, 1, None), (None, None, 1, None),
            ("1:", 2.0, 3, b"y"), ("1", 2.0, 3, b"y"), ("z" * 90000, 1.0, 1, b"q"), ("z" * 90000, 1.0, 1, b"q"), ("a3:1.0", 1.0, None, b"x")]
    df = spark.createDataFrame(rows, "s string, d double, i int, b binary")
    plain = df.groupBy(*df.columns).count().agg(F.sum(F.col("count") - 1)).first()[0]
    assert tuple(rules.repeats(df, df.columns).first()) == (14, plain) == (14, 4)
    assert rules.repeats(df.withColumn("n", F.array("i")), ["s", "n"]).first()["bad"] == 6
    stamps = spark.createDataFrame([("x", datetime.datetime(2024, 1, 1, 0, 0, 0, k)) for k in (1, 2, 2)], "s string, t timestamp")
    assert rules.repeats(stamps, ["s", "t"]).first()["bad"] == 1


def test_checks_over_batches_share_a_pass(spark):
    class Spread(rules.BatchCheck):
        """Rows far from the middle of a column, by sums that batches add to; then at most the share that any distribution allows is expected."""

        columns = ["v"]

        def start(self):
            return [0, 0.0, 0.0]

        def add(self, state, batch):
            v = batch.to_pandas().v.dropna()
            return [state[0] + len(v), state[1] + v.sum(), state[2] + (v * v).sum()]

        def result(self, state):
            n, total, squares = state
            return int(n), int(n > 0 and squares / n - (total / n) ** 2 > 4)

    rng = np.random.default_rng(2)
    pdf = [(int(k), datetime.date(2024, 1, 1) + datetime.timedelta(days=int(k) % 50 * 2), float(v)) for k, v in enumerate(rng.normal(0, 3, 900))] + [(None, None, None), (-5, None, 1.0)]
    df = spark.createDataFrame(pdf, "k long, day date, v double").repartition(6)
    held = {"digit": checks.CheckDigit("k"), "gap": checks.GapCheck("day"), "spread": Spread(), "rows": checks.FrameCheck(["v", "k"], lambda f: (f.v.notna().sum(), (f.v > 1).sum()))}
    got = {r["rule_id"]: (r["n"], r["bad"]) for r in rules.batch_counts(df, held).collect()}

    def luhn(k):
        digits = [int(c) for c in reversed(str(k))]
        return sum(d if i % 2 == 0 else sum(map(int, str(2 * d))) for i, d in enumerate(digits)) % 10 == 0

    assert got["digit"] == (902, sum(k is None or k < 0 or not luhn(k) for k, *_ in pdf))
    assert got["gap"] == (99, 49) and got["spread"] == (901, 1)
    assert got["rows"] == (901, sum(v is not None and v > 1 for *_, v in pdf))
    rule = rules.compiled([{"rule_id": "G", "dataset": "t", "column": "day", "dimension": "timeliness", "kind": "aggregate", "params": {"check": "gap"}}], held)[0]
    assert result(spark, rule, t=df) == (50.51, 49)
    assert result(spark, rule, t=df.where("false")) == (100.0, 0)
    plan = rules.batch_counts(df, held)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("MapInArrow") == 1


def test_callables_of_a_frame_still_count(spark):
    rule = rules.Rule("C", "t", "v", "accuracy", "aggregate", {"check": lambda df: df.agg(F.count("*").alias("n"), F.count_if(F.col("id") > 6).alias("bad"))})
    assert result(spark, rule, t=spark.range(10)) == (70.0, 3)


def test_lookups_join_measures(spark):
    orders = spark.createDataFrame([(1, 10.0), (2, 5.0), (3, 1.0), (None, 7.0)], "k int, total double")
    lines = spark.createDataFrame([(1, 4.0), (1, 6.0), (2, 9.0), (None, 7.0)], "o int, price double")
    row = {"rule_id": "L-1", "dataset": "orders", "column": "total", "dimension": "accuracy", "kind": "lookup", "params": {"table": "lines", "on": json.dumps({"k": "o"}), "measure": json.dumps({"goods": "sum(price)"}), "passes": "total = goods"}}
    of = lambda **p: result(spark, rules.compiled([row | {"params": row["params"] | p}])[0], orders=orders, lines=lines)
    assert of() == (25.0, 3)
    assert of(of="k < 3") == (50.0, 1)
    assert of(passes="goods is null") == (50.0, 2)
    assert of(on="{}", passes="total < goods") == (100.0, 0)
    with pytest.raises(ValueError, match="named like columns"):
        of(measure=json.dumps({"total": "sum(price)"}))
    two = rules.compiled([row, row | {"rule_id": "L-2", "params": row["params"] | {"measure": json.dumps({"goods": "max(price)"}), "passes": "goods > 5"}}])
    assert {r["rule_id"]: r["affected_rows"] for r in rules.evaluate_rules(spark, two, {"orders": orders, "lines": lines}).collect()} == {"L-1": 3, "L-2": 2}
