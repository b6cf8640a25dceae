"""Operators on small hand-made frames."""

import pytest

from tablewarden.functions import names
from tablewarden.operators import bi_models, lineage, mdm, profile, rules
from tablewarden.plans import catalog
from tablewarden.sources import files


def test_auto_rules_of_a_table_with_gaps(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/nation.parquet").selectExpr("n_nationkey as id", "if(n_nationkey % 12 = 0, null, n_name) as label", "n_regionkey as region")
    found = rules.auto_rules(profile.profile_table(df, "id").collect(), 25)
    out = {(r["column"], r["dimension"]): r for r in rules.evaluate_rules(spark, found, {"table": df}).collect()}
    assert set(out) == {("id", "uniqueness"), ("label", "completeness"), ("*", "uniqueness")}
    assert out["id", "uniqueness"]["status"] == out["*", "uniqueness"]["status"] == "pass"
    assert (out["label", "completeness"]["score"], out["label", "completeness"]["affected_rows"], out["label", "completeness"]["status"]) == (88.0, 3, "fail")


def test_empty_table(spark):
    df = spark.createDataFrame([], "a string")
    assert rules.auto_rules(profile.profile_table(df).collect(), 0) == []
    empty = rules.evaluate_rules(spark, [], {})
    assert empty.columns == rules.RESULT_COLUMNS and empty.count() == 0
    scored = rules.evaluate_rules(spark, [rules.Rule("X", "t", "a", "completeness", "not_null")], {"t": df}).first()
    assert scored["score"] == 100.0 and scored["affected_rows"] == 0


def test_duplicate_row_and_nulls_equal(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", "x"), ("c", "y")], "k string, v string")
    out = rules.evaluate_rules(spark, [rules.Rule("D", "t", "*", "uniqueness", "no_duplicate_rows", {}, 98.0)], {"t": df}).first()
    assert out["affected_rows"] == 1 and out["status"] == "fail"


def test_status_band_is_two_points(spark):
    df = spark.range(100).selectExpr("if(id < 6, null, id) as v")
    status = lambda t: rules.evaluate_rules(spark, [rules.Rule("S", "t", "v", "completeness", "not_null", {}, t)], {"t": df}).first()["status"]
    assert [status(94.0), status(96.0), status(96.5)] == ["pass", "warn", "fail"]


def test_golden_record_fills_gaps_and_guard(spark):
    df = spark.createDataFrame([(1, "Ana", None, "55"), (2, "Ana", "a@x.org", None)], "id long, name string, email string, phone string")
    members = spark.createDataFrame([(1, 1), (2, 1)], "node long, component long")
    assert mdm.golden_records(df, "id", members).first().asDict() == {"component": 1, "id": 1, "name": "Ana", "email": "a@x.org", "phone": "55"}
    with pytest.raises(ValueError):
        mdm.candidate_pairs(spark.range(200).withColumnRenamed("id", "k"), "k", None, [])


def test_lineage_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert {r["node"] for r in lineage.downstream(edges, "a").collect()} == {"b", "c", "d"}
    assert lineage.upstream(spark.createDataFrame([("a", "b")], "src string, dst string"), "a").count() == 0


def test_names(spark):
    df = spark.createDataFrame([("customerEmail",), ("monto",), ("full_name2",), ("width",)], "n string")
    got = [r[0] for r in df.select(names.pii_name(df["n"])).collect()]
    assert got == [True, False, True, False]
    people = spark.createDataFrame([("Ana Ruiz",), ("Data team",), ("Team web",), ("",), (None,)], "n string")
    assert [r[0] for r in people.select(names.named_person(people["n"])).collect()] == [True, True, False, False, False]
    q = spark.createDataFrame([('Sql.Database("srv", "db")',), ('Value.NativeQuery(x, "s")',), ('Csv.Document(y)',), ("let x = 1",)], "q string")
    assert [r[0] for r in q.select(names.source_label(q["q"])).collect()] == ["srv/db", "native query", "Csv", None]


def test_names_of_sources_and_masks(spark):
    q = spark.createDataFrame([('let x = Table.Skip(Folder.Files("c"), 1) in x',), ('Odbc.DataSource("dsn")',), ("Table.FromRows({})",), (None,)], "q string")
    assert [r[0] for r in q.select(names.source_label(q["q"])).collect()] == ["Folder", "Odbc", None, None]
    m = spark.createDataFrame([("ana@x.org",), ("ana.ruiz",), ("@x",), ("a@",), ("",), (None,)], "m string")
    assert [r[0] for r in m.select(names.masked_email(m["m"])).collect()] == ["a***@x.org", "***", "***", "***", "***", None]
    t = spark.createDataFrame([("orderLine2ID_x-y",)], "n string")
    assert t.select(names.tokens(t["n"])).first()[0] == ["order", "line", "id", "x", "y"]


def test_a_model_without_measures_and_columns(spark, tmp_path):
    scan = tmp_path / "scan.json"
    scan.write_text('{"workspaces":[{"name":"w","datasets":[{"id":"d1","name":"Empty","tables":[],"relationships":[],"roles":[]}],"reports":[]}]}')
    t = bi_models.tenant_tables(bi_models.read_tenant(spark, str(scan)))
    got = {r["rule_id"]: (r["score"], r["affected_rows"], r["status"]) for r in bi_models.tenant_health(t).collect()}
    assert got == {"PBI-01": (0.0, 1, "fail"), "PBI-02": (100.0, 0, "pass"), "PBI-03": (0.0, 1, "fail"), "PBI-04": (0.0, 0, "fail"), "PBI-05": (0.0, 0, "fail")}


def test_chains_of_links_are_one_cluster(spark):
    pairs = spark.createDataFrame([(k, k + 1, 0.9 if k % 2 else 1.0, ["x"]) for k in range(60) if k != 30] + [(100, 101, 0.4, ["x"])], "a long, b long, score double, matched_on array<string>")
    members, report = mdm.clusters(pairs, 0.5)
    assert {r["node"]: r["component"] for r in members.collect()} == {k: 0 if k <= 30 else 31 for k in range(61)}
    assert {(r["component"], r["rows"], r["confidence"]) for r in report.collect()} == {(0, 31, 1.0), (31, 30, 1.0)}


def test_numbers_of_ranges_follow_each_other(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 as g")
    got = mdm.numbered(df, [df["g"].desc(), df["id"].asc()], "k").toPandas().sort_values(["g", "id"], ascending=[False, True])
    assert got.k.tolist() == list(range(1, 5001))


def test_compact_dates_of_odd_numbers(spark):
    df = spark.createDataFrame([(20240131.0,), (float("nan"),), (1e30,), (None,)], "d double")
    rule = rules.Rule("C", "t", "d", "validity", "compact_date")
    assert rules.evaluate_rules(spark, [rule], {"t": df}).first()["affected_rows"] == 3


def test_files_and_stages(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;2\n3;4\n")
    df, cut = files.read_delimited(spark, str(tmp_path / "a.csv"), 1)
    assert df.columns == ["x", "y"] and df.count() == 1 and cut
    root = str(tmp_path / "stages")
    files.save_stage(spark, root, "c", "s1", {"t": spark.range(3).toDF("id"), "none": spark.range(0).toDF("id")})
    assert files.list_stages(spark, root, "c").first()["tables"] == 1
    assert files.load_stage(spark, root, "c", "s1")["t"].count() == 3
    with pytest.raises(ValueError):
        files.save_stage(spark, root, "c", "s2", {"none": spark.range(0).toDF("id")})
    assert files.list_stages(spark, root, "nobody").count() == 0 and files.stage_summary(spark, root, "nobody").first()["stages"] == 0


def test_queries_that_only_read():
    for good in ("select 1", " WITH x as (select 1) select * from x", "-- note\n(/* a */ Select 1)"):
        assert files.guarded(good) == good
    for bad in ("delete from t", "-- select\ndrop table t", "selectx", "/* select", ""):
        with pytest.raises(ValueError):
            files.guarded(bad)


def test_limits_in_each_dialect():
    assert files.limited_query("jdbc:postgresql://h/d", "s.t", 5) == 'SELECT * FROM "s"."t" LIMIT 5'
    assert files.limited_query("jdbc:sqlserver://h", "t", 10**9) == 'SELECT TOP 100000 * FROM "t"'
    assert files.limited_query("jdbc:mysql://h/d", "a`b", 0) == "SELECT * FROM `a``b` LIMIT 1"
    assert files.limited_query("jdbc:oracle:thin:@h", "t", 7) == 'SELECT * FROM "t" FETCH FIRST 7 ROWS ONLY'


def test_a_stream_is_evaluated_batch_by_batch(spark, tmp_path):
    from tablewarden.streaming import evaluate_stream

    spark.range(10).selectExpr("if(id < 3, null, id) as v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("v bigint").parquet(str(tmp_path / "in"))
    query = evaluate_stream(stream, [rules.Rule("S", "t", "v", "completeness", "not_null")], "t", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).agg({"affected_rows": "sum"}).first()[0] == 3


def test_numbers_beyond_999_stay_apart(spark, monkeypatch):
    members = spark.range(2400).selectExpr("id as node", "id div 2 as component")
    found = members.groupBy("component").count().selectExpr("component", "count as rows", "1.0D as confidence", "array('a') as matched_on")
    monkeypatch.setattr(catalog, "_people", lambda spark, sf_dir: (None, members, found))
    got = {r["cluster_id"]: r["row_indices"] for r in catalog.report(spark, "").collect()}
    assert got == {f"DUP-{k + 1:03d}": f"{2 * k},{2 * k + 1}" for k in range(1200)}
    terms = spark.range(1200).selectExpr("'m' as model", "format_string('%05d', id) as measure", "'x' as expression")
    ids = {r["term"]: r["term_id"] for r in bi_models.numbered_terms(terms, "M", "model", "measure", "expression").collect()}
    assert ids == {f"{k:05d}": f"M{k + 1:03d}" for k in range(1200)}


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    from tablewarden.sources import scratch

    assert spark.sparkContext.applicationId in scratch.scratch_root(spark)
    monkeypatch.setattr(scratch, "scratch_root", lambda spark: f"file://{tmp_path}/shared")
    assert scratch.written(spark.range(3)).count() == 3
    assert len(list(tmp_path.glob("shared/*/_SUCCESS"))) == 1
    assert scratch.clear(spark) and not list(tmp_path.glob("*")) and not scratch.clear(spark)
