"""Containment, matching blocks, tiles, long chains, wide tables, governed views: plain versions and plans."""

import contextlib
import io
import itertools
import random
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewarden.functions import blocks, names, tiles
from tablewarden.operators import governance, lineage, mdm, profile, protect
from tablewarden.operators.containment import contained

DATA = "/root/testdata/sf0.01"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@contextlib.contextmanager
def settings(spark, **values):
    old = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


JOINS = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}


def test_names_in_texts_equal_a_nested_loop(spark):
    rng = random.Random(3)
    letters = "abä😀 _"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 25))) for _ in range(120)] + ["", None, "a" * 5000, "customer_d", "xcustomer_dx", "😀b"]
    wanted = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(60)] + ["", None, "aaaa", "customer_d", "never there", "😀b", "x" * 50]
    t, n = spark.createDataFrame([(x, 1) for x in texts + texts[:9]], "txt string, name string"), spark.createDataFrame([(x, 1) for x in wanted + wanted[:9]], "nm string, text int")
    got = contained(t, "txt", n, "nm")
    want = {(x, y) for x in texts for y in wanted if x is not None and y is not None and y in x}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    with settings(spark, **JOINS):
        text = plan(contained(t, "txt", n.where("nm <> ''"), "nm"))
    assert "SortMergeJoin" in text and text.count("NestedLoop") + text.count("CartesianProduct") <= 1  # the empty name's one row
    assert contained(t.where("false"), "txt", n, "nm").count() == contained(t, "txt", n.where("false"), "nm").count() == 0


def test_coverage_by_text(spark):
    base = spark.createDataFrame([("a_b", "PII", None, None), ("c", "", "Ana Ruiz", None)], "dataset string, classification string, owner string, steward string")
    items = spark.createDataFrame([("a_b, c", "validado"), ("x/a_b", "sugerido_ia"), (None, "validado"), ("", "validado")], "dataset string, status string")
    none = spark.createDataFrame([], "dataset string")
    got = {r["dataset"]: r["curation_pct"] for r in governance.coverage(base.select("dataset", "classification"), base.select("dataset", "owner", "steward"), none, items).collect()}
    assert got == {"a_b": 50.0, "c": 100.0}


def test_matching_blocks_equal_the_standard_library(spark):
    rows = spark.read.parquet(f"{DATA}/supplier.parquet").select("s_suppkey", "s_name").collect()
    texts = [r["s_name"] for r in rows] + [" Ana RUIZ ", "ana ruiz", "", None, "a" * 400 + "b", "b" + "a" * 300]
    pairs = list(itertools.combinations(texts, 2))
    plain = lambda x: "" if x is None else x.strip().lower()
    want = [SequenceMatcher(None, plain(a), plain(b)).ratio() if plain(a) and plain(b) else 0.0 for a, b in pairs]
    assert blocks.ratios(*map(list, zip(*pairs))) == want
    high = blocks.ratios(*map(list, zip(*pairs)), least=0.9)
    assert [x for x in high if x >= 0.9] == [x for x in want if x >= 0.9]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k long, a string, b string").repartition(3)
    assert [r["r"] for r in df.select("k", blocks.matching_ratio(F.col("a"), F.col("b")).alias("r")).orderBy("k").collect()] == want


def test_scores_by_matching_blocks(spark):
    df = spark.createDataFrame([(1, "x", "Maria Lopez"), (2, "x", "Maria López "), (3, "x", "Mario Perez"), (4, "x", None)], "id long, block string, name string")
    got = {(r["a"], r["b"]): (round(r["score"], 6), r["matched_on"]) for r in mdm.scored_pairs(mdm.candidate_pairs(df, "id", "block", ["name"]), "id", [mdm.Match("name", 2.0, "blocks", 0.8)]).collect()}
    assert got[1, 2] == (round(SequenceMatcher(None, "maria lopez", "maria lópez").ratio(), 6), ["name"])
    assert got[1, 3] == (0.0, []) and got[1, 4] == (0.0, []) and len(got) == 6


def test_pairs_of_a_large_block_are_spread(spark):
    df = spark.range(3000).selectExpr("id as k", "case when id % 2 = 0 then 'big' when id % 97 = 1 then null else concat('b', id % 300) end as block", "concat('v', id) as v")
    small = mdm.candidate_pairs(df.where("k < 700"), "k", "block", ["v"], rows_a_tile=40)
    rows = [(r["k"], r["block"], r["v"]) for r in df.where("k < 700").collect()]
    want = {(a, b) for (a, x, _), (b, y, _) in itertools.combinations(rows, 2) if x is not None and x == y}
    got = small.collect()
    assert len(got) == len(want) and {(r["a_k"], r["b_k"]) for r in got} == want
    assert all(r["a_v"] == f"v{r['a_k']}" and r["b_v"] == f"v{r['b_k']}" and r["a_block"] == r["b_block"] for r in got)
    with settings(spark, **JOINS, **{"spark.sql.shuffle.partitions": "8"}):
        each = [r["count"] for r in mdm.candidate_pairs(df, "k", "block", [], rows_a_tile=100).groupBy(F.spark_partition_id()).count().collect()]
    assert len(each) == 8 and sum(each) > 1500 * 1499 // 2 and max(each) <= 2 * sorted(each)[4]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def odd_texts(rng):
    made = ["".join(rng.choice("ab1Éß語😀 ") for _ in range(rng.randrange(12))) for _ in range(30)] + [f"Supplier#{rng.randrange(400):09d}" for _ in range(25)]
    long = ["x" * 63 + "y", "x" * 64 + "y", "x" * 70, "abc" * 30, "abc" * 29 + "abd", "a" * 400]
    return list(dict.fromkeys([*made, *long, "", " ", "a" * 6]))


@pytest.mark.parametrize("least", [0.0, 0.5, 0.85, 1.0])
def test_likeness_of_all_pairs(least):
    texts = odd_texts(random.Random(11))
    a, b = (np.array(x) for x in zip(*itertools.product(range(len(texts)), repeat=2)))
    for kind in ("fuzzy", "blocks"):
        got = tiles.Likeness(texts, kind, least)(a, b)
        if kind == "fuzzy":
            want = [1 - plain_distance(x, y) / max(len(x), len(y)) if x and y else 0.0 for x, y in itertools.product(texts, repeat=2)]
        else:
            want = blocks.ratios([texts[k] for k in a], [texts[k] for k in b])
        assert [x if x >= least else 0 for x in got.tolist()] == [x if x >= least else 0 for x in want]
    assert tiles.Likeness(texts, "fuzzy", least)(np.array([-1, 3]), np.array([3, -1])).tolist() == [0, 0]


@pytest.mark.parametrize("tile", [7, 2000])
def test_scores_of_tiles_equal_those_of_joined_pairs(spark, tile):
    rng = random.Random(4)
    texts = odd_texts(rng)
    rows = [(f"k{k}" if k else None, rng.choice(["big", "big", "b", None]), rng.choice([*texts, " Ana RUIZ", "ana ruiz", None]), rng.choice([1.0, 2.5, None])) for k in range(130)]
    df = spark.createDataFrame(rows, "id string, block string, name string, amount double")
    matches = [mdm.Match("name", 1.0, "fuzzy", 0.7), mdm.Match("amount", 1.5), mdm.Match("name", 0.3, "blocks", 0.6)]
    want = sorted(map(tuple, mdm.scored_pairs(mdm.candidate_pairs(df, "id", "block", ["name", "amount"]), "id", matches).collect()))
    got = mdm.block_scores(df, "id", "block", matches, rows_a_tile=tile, large=0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 2500
    assert sorted(map(tuple, mdm.block_scores(df, "id", "block", matches, named=False, rows_a_tile=tile, large=0).collect())) == [x[:3] for x in want]


def test_few_rows_with_many_pairs_are_spread(spark, tmp_path):
    spark.range(3000).selectExpr("id as k", "0 as block", "concat('v', id) as v").coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")  # small enough to be sent to the tasks of the other side, which is one file
    for pairs in (mdm.candidate_pairs(df, "k", "block", [], rows_a_tile=200), mdm.block_scores(df, "k", "block", [mdm.Match("v")], rows_a_tile=200)):
        assert pairs.groupBy(F.spark_partition_id()).count().count() == 4


def test_large_blocks_under_any_name(spark):
    df = spark.range(50).selectExpr("id as k", "0 as _block")
    assert mdm.candidate_pairs(df, "k", "_block", [], rows_a_tile=9).count() == 50 * 49 // 2


@pytest.mark.parametrize("least", [0.3, 0.5, 0.9])
def test_clusters_of_classes_equal_those_of_all_pairs(spark, least, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.randrange(150), rng.choice(["x", "y", None]), rng.choice(["Ana Ruiz", " ana ruiz", "Ana Ruis", "Leo Paz", "", None]), rng.choice([0.0, -0.0, 1.5, None])) for _ in range(120)] + [(500 + k, f"z{k // 2}", "Eva", 2.0 + k) for k in range(8)]
    df = spark.createDataFrame(rows, "id long, block string, name string, amount double")
    matches = [mdm.Match("name", 1.0, "fuzzy", 0.8), mdm.Match("amount", 1.5)]
    want, got = mdm.clusters(mdm.scored_pairs(mdm.candidate_pairs(df, "id", "block", ["name", "amount"]), "id", matches), least), mdm.clustered(df, "id", "block", matches, least)
    for w, g in zip(want, got):
        assert sorted(map(str, w.collect())) == sorted(map(str, g.collect()))


def test_pairs_of_rows_that_are_alike_are_not_written(spark, monkeypatch):
    made = []
    monkeypatch.setattr(mdm, "written", lambda df, old=mdm.written: made.append(old(df)) or made[-1])
    df = spark.range(2000).selectExpr("id", "'b' as block", "concat('v', id % 2) as v")
    members, report = mdm.clustered(df, "id", "block", [mdm.Match("v")], 0.9)
    assert members.groupBy("component").count().orderBy("component").collect() == [(0, 1000), (1, 1000)] and report.count() == 2
    assert max(d.count() for d in made) <= 2000  # a million pairs


def plain_closure(edges, start):
    seen, frontier, depth, out = {start}, {start}, 0, {}
    while frontier:
        depth += 1
        frontier = {b for a, b in edges if a in frontier} - seen
        seen |= frontier
        out |= {(start, x): depth for x in frontier}
    return out


@pytest.mark.parametrize("growth", [4, -1000])
def test_closure_of_odd_graphs(spark, growth):
    rng = random.Random(5)
    edges = {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(60)} | {(f"c{k}", f"c{(k + 1) % 11}") for k in range(11)} | {("c3", "n1"), ("x", "x")} | {(f"d{k}", f"d{j}") for k in range(9) for j in range(9)}
    df = spark.createDataFrame([*edges, *list(edges)[:5], (None, "n1"), ("n1", None)], "src string, dst string")
    want = {}
    for s in {x for e in edges for x in e}:
        want |= plain_closure(edges, s)
    got = lineage.closure(df, growth=growth).collect()  # without room for jumps only the last nodes met go on
    assert {(r["start"], r["node"]): r["depth"] for r in got} == want and len(got) == len(want)


def test_a_chain_of_ten_thousand_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(lineage, "written", lambda df, old=lineage.written: rounds.append(1) or old(df))
    edges = spark.range(10_000).selectExpr("concat('n', id) as src", "concat('n', id + 1) as dst").unionByName(spark.createDataFrame([("n10000", "n4")], "src string, dst string"))
    got = lineage.downstream(edges, "n0").selectExpr("count(*) as n", "max(depth) as top", "sum(depth) as s", "count_if(node = concat('n', depth)) as right").first()
    assert tuple(got) == (10_000, 10_000, 10_000 * 10_001 // 2, 10_000)
    assert len(rounds) < 40


def test_jumps_over_chains_are_joined_once_and_end_with_them(spark, monkeypatch):
    made = []
    monkeypatch.setattr(lineage, "written", lambda df, old=lineage.written: made.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString())) or old(df))
    chains = [(f"c{c}_{k}", f"c{c}_{k + 1}") for c in range(40) for k in range(10)]
    cycle = [("z0", "z1"), ("z1", "z2"), ("z2", "z0")]
    got = lineage.closure(spark.createDataFrame(chains, "src string, dst string"), spark.createDataFrame([(f"c{c}_0",) for c in range(40)], "start string"))
    assert {tuple(r) for r in got.collect()} == {(f"c{c}_0", f"c{c}_{k}", k) for c in range(40) for k in range(1, 11)}
    jumps = [plan for columns, plan in made if columns == ["at", "next"]]
    assert len(made) == 10 and not any("Aggregate" in plan for plan in jumps[1:])
    got = lineage.closure(spark.createDataFrame([*cycle, ("z1", "y")], "src string, dst string")).collect()
    assert {(r["start"], r["node"], r["depth"]) for r in got} == {("z0", "z1", 1), ("z0", "z2", 2), ("z0", "y", 2), ("z1", "z2", 1), ("z1", "z0", 2), ("z1", "y", 1), ("z2", "z0", 1), ("z2", "z1", 2), ("z2", "y", 3)}


def test_distinct_values_of_a_wide_table(spark):
    wide = spark.range(60).select("id", *(F.when(F.col("id") % (k + 2) != 0, F.col("id") % (k + 1)).alias(f"c{k}") for k in range(200)))
    found = profile.profile_table(wide, "id").select("column", "unique_values")
    assert "Expand" not in plan(found)
    got = {r["column"]: r["unique_values"] for r in found.collect()}
    rows = wide.collect()
    assert got == {c: len({r[c] for r in rows} - {None}) for c in wide.columns}


def test_distinct_values_of_odd_types(spark):
    long = "x" * 1000
    rows = [(1.5, float("nan"), "a", b"\x01", [1, None], True), (-0.0, float("nan"), long + "1", b"\x01", [1, None], None), (0.0, None, long + "2", b"", [1], False), (None, 2.0, "#a", None, None, True), (1e300, 2.0, "", b"\x02", [], True)]
    df = spark.createDataFrame(rows, "d double, n double, s string, b binary, a array<int>, t boolean")
    want = df.agg(*(F.count_distinct(c).alias(c) for c in df.columns)).first().asDict()
    assert {df.columns[r["position"]]: r["unique_values"] for r in profile.distinct_counts(df, 4).collect()} == want
    assert profile.profile_table(df.where("false")).agg(F.sum("unique_values")).first()[0] == 0
    assert profile.profile_table(df.select("s", "d"), "s", approximate=True).count() == 2


def test_layers_in_the_order_of_rows(spark):
    flat = spark.createDataFrame([(1, "a", "z", "b", "y"), (2, "b", "x", "a", "w"), (0, "c", "q", "c", "p")], "k int, source string, source_layer string, target string, target_layer string")
    layers = lambda nodes: {r["id"]: r["layer"] for r in nodes.collect()}
    assert layers(lineage.from_flat(flat, "k")[0]) == {"a": "z", "b": "y", "c": "q"}
    assert layers(lineage.from_flat(flat)[0]) == {"a": "w", "b": "x", "c": "p"}


def test_folding_equals_decomposition(spark):
    letters = [chr(k) for k in range(0x20, 0x2000) if unicodedata.category(chr(k))[0] in "LM"]
    pieces = [f"x{c}y" for c in letters] + ["Área de Ñandú", "é", " Ǻ "]
    got = [r[0] for r in spark.createDataFrame([(k, p) for k, p in enumerate(pieces)], "k int, p string").orderBy("k").select(names.folded(F.col("p"))).collect()]
    want = ["".join(c for c in unicodedata.normalize("NFKD", p) if not unicodedata.combining(c)).lower().strip() for p in pieces]
    plain = lambda c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    several = {f"x{c}y" for c in letters if len(plain(c)) > 1}
    wrong = [p for p, a, b in zip(pieces, got, want) if a != b and p not in several]
    assert len(wrong) <= 5, wrong  # capitals whose small form is of several letters
    assert got[-3:] == ["area de nandu", "e", "a"]


def test_views_show_what_a_user_may_see(spark):
    people = spark.createDataFrame([(1, "Ana", "ana@x.org", "es"), (2, "Leo", None, "fr"), (3, None, "eva@x.org", None)], "id int, name string, email string, land string")
    tables = {"people": people, "plain": people.select("id", "land")}
    described = spark.createDataFrame([("people", "name", True), ("people", "email", True), ("people", "id", False), ("plain", "id", False)], "dataset string, column string, pii boolean")
    plan_ = spark.createDataFrame([("people", "privacy"), ("people", "analyst"), ("plain", "analyst"), ("plain", None)], "dataset string, role string")
    members = spark.createDataFrame([("ana", "privacy"), ("leo", "analyst"), ("eva", "guest")], "user string, role string")
    entitled = spark.createDataFrame([("leo", "people", "land", "es"), ("leo", "people", "id", "1"), ("leo", "people", "id", "2"), ("leo", "people", "id", "2"), ("ana", "people", "land", "fr")], "user string, dataset string, column string, value string")
    of = lambda user, given=plan_: protect.governed_views(tables, described, given, members, entitled, user, frozenset({"privacy"}))
    assert of("leo") == {"people": "leo_people", "plain": "leo_plain"} and of("eva") == {}
    assert [tuple(r) for r in spark.sql("select * from leo_people").collect()] == [(1, "***", "a***@x.org", "es")]
    assert spark.sql("select count(*) from leo_plain").first()[0] == 3
    assert of("ana") == {"people": "ana_people"} and spark.sql("select * from ana_people").count() == 0  # ana has no id of her own
    assert of("leo", plan_.where("dataset = 'plain'")) == {"plain": "leo_plain"} and not spark.catalog.tableExists("leo_people")


def test_golden_records_are_summed_within_tasks(spark):
    df = spark.range(1000).selectExpr("id", "if(id % 3 = 0, null, concat('n', id)) as name")
    text = plan(mdm.golden_records(df, "id", df.selectExpr("id as node", "0 as component")))
    assert "partial_min_by" in text


def test_two_actions_for_one_key_do_not_double_alerts(spark):
    remedies = spark.createDataFrame([("rule", "R", "b"), ("rule", "R", "a"), ("dimension", "completeness", "c"), ("dimension", "completeness", "d")], "scope string, key string, action string")
    issues = spark.createDataFrame([("R", "validity"), ("S", "completeness"), ("T", "validity")], "rule_id string, dimension string")
    assert sorted((r["rule_id"], r["action"]) for r in governance.with_remedy(issues, remedies).collect()) == [("R", "a"), ("S", "c"), ("T", "c")]
