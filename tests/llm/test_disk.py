"""What the operators leave in the shared folder once their result is there."""

import uuid

import numpy as np
import pytest

from tablewarden.llm import common, compact_windows, jaccard_join

VOCAB = [f"w{i}" for i in range(400)]


@pytest.fixture
def shared(monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"{tmp_path}/shared/tablewarden-{uuid.uuid4().hex}")
    return tmp_path / "shared"


def near_rows(many):
    """Copies of a few originals with changed words, so that cells, boundaries and several turns come up."""
    rng, rows = np.random.default_rng(5), []
    for i in range(many):
        words = list(np.random.default_rng(i % 7).choice(VOCAB, 120))
        for k in rng.choice(120, int(rng.integers(0, 9)), replace=False):
            words[k] = str(rng.choice(VOCAB[:12])) + "q"
        rows.append((i, " ".join(words)))
    return rows


def found(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def test_near_duplicates_leave_only_what_the_result_reads(spark, shared):
    docs = spark.createDataFrame(near_rows(120), "doc_id long, text string").repartition(3)
    out = jaccard_join.near_duplicates(docs)
    want = found(out)
    assert len(want) == 120 and len({c for _, _, c in want}) < 120
    names = [spark.read.parquet(str(p)).columns for p in shared.iterdir()]
    assert sorted(n[0] for n in names if "component" in n or "shared" in n) == ["cls", "doc_id"] and not [n for n in names if {"shingles", "token", "pivot", "cell"} & set(n)]


def test_sets_are_measured_alike_whether_picked_or_shuffled(spark, shared, monkeypatch):
    docs = spark.createDataFrame(near_rows(80), "doc_id long, text string").repartition(3)
    picked = found(jaccard_join.near_duplicates(docs))
    monkeypatch.setattr(jaccard_join, "FEW", 0)
    assert found(jaccard_join.near_duplicates(docs)) == picked


def test_near_duplicate_stage_leaves_its_result_and_small_tables(spark, shared, monkeypatch):
    """The numbered copy of the rows is gone; what stays beside the result holds no texts or sets."""
    import corpus_pipeline

    docs = spark.createDataFrame([(i, t, "x") for i, t in near_rows(120)], "doc_id long, text string, source string").repartition(3)
    out = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    left = {r["doc_id"] for r in out.collect()}
    groups = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(docs).collect()}
    assert left == set(groups.values())
    names = [spark.read.parquet(str(p)).columns for p in shared.iterdir()]
    assert [n for n in names if "text" in n] == [["doc_id", "text", "source"]] and not [n for n in names if "shingles" in n or "token" in n]


KEYS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


def thresholds(spark, monkeypatch, module):
    """Collects the settings of broadcasts that hold whenever module writes a table."""
    seen, whole = [], common.stored

    def looked_at(df, *args):
        seen.append(tuple(spark.conf.get(k, None) for k in KEYS))
        return whole(df, *args)

    monkeypatch.setattr(module, "stored", looked_at)
    return seen


def test_near_duplicates_have_only_small_tables_built_in_the_driver(spark, shared, monkeypatch):
    docs = spark.createDataFrame(near_rows(20), "doc_id long, text string").coalesce(1)
    before = [spark.conf.get(k, None) for k in KEYS]
    seen = thresholds(spark, monkeypatch, jaccard_join)
    assert len(found(jaccard_join.near_duplicates(docs))) == 20 and jaccard_join.FEW <= 1 << 14
    assert len(seen) > 10 and set(seen) == {("262144", None)} and [spark.conf.get(k, None) for k in KEYS] == before


def test_settings_that_are_smaller_stay(spark):
    before = [spark.conf.get(k, None) for k in KEYS]
    with common.settings(spark, dict(zip(KEYS, ("-1", "1m")))):
        with common.small_broadcasts(spark):
            assert [spark.conf.get(k) for k in KEYS] == ["-1", "262144"]
        assert [spark.conf.get(k) for k in KEYS] == ["-1", "1m"]
    assert [spark.conf.get(k, None) for k in KEYS] == before and [common.size_of(x) for x in ("10485760b", "256k", "-1", "2 MB")] == [10 << 20, 256 << 10, -1, 2 << 20]


def test_near_duplicate_stage_has_only_small_tables_built_in_the_driver(spark, shared, monkeypatch):
    """Which rows stay grows with the input."""
    import corpus_pipeline

    docs = spark.createDataFrame([(i, f"words of text {i % 3}") for i in range(9)], "doc_id long, text string")
    monkeypatch.setattr(corpus_pipeline.jaccard_join, "near_duplicates", lambda rows: rows.selectExpr("doc_id", "4L as n_shingles", "crc32(text) as component_id"))
    seen = thresholds(spark, monkeypatch, corpus_pipeline)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == [0, 1, 2] and seen[-1] == ("262144", None)


def passage_rows():
    """Texts that share a passage, exact or with changed words, between words of their own."""
    rows = []
    for i in range(20):
        rng = np.random.default_rng(1000 + i)
        passage = list(np.random.default_rng(i % 6).choice(VOCAB, 90))
        for k in rng.choice(90, int(rng.integers(0, 4)), replace=False):
            passage[k] = f"new{i}x{k}"
        rows.append((i, " ".join([f"own{i}x{k}" for k in range(30)] + passage + list(rng.choice(VOCAB, 40)))))
    return rows


def test_near_passages_keep_no_texts_and_no_shingles(spark, shared):
    docs = spark.createDataFrame(passage_rows(), "doc_id long, text string").repartition(3)
    out = compact_windows.near_passages(docs)
    assert out.count() >= 8
    names = [set(spark.read.parquet(str(p)).columns) for p in shared.iterdir()]
    assert names and not [n for n in names if n & {"text", "hashes", "data", "cut0"}]


def test_passages_are_measured_alike_in_one_turn_and_in_several(spark, shared, monkeypatch):
    docs = spark.createDataFrame(passage_rows(), "doc_id long, text string").repartition(3)
    turns, whole = [], compact_windows.measured

    def counted(pairs, chunks, s):
        turns.append(1)
        return whole(pairs, chunks, s)

    monkeypatch.setattr(compact_windows, "measured", counted)
    one = sorted(map(tuple, compact_windows.near_passages(docs).collect()))
    assert len(turns) == 1
    monkeypatch.setattr(compact_windows, "LEAST_ROOM", 40_000)
    monkeypatch.setattr(compact_windows, "ROOM", 0)
    assert sorted(map(tuple, compact_windows.near_passages(docs).collect())) == one and len(turns) > 2


def test_windows_of_much_repeated_values_are_those_of_brute_force():
    for k in range(40):
        rng = np.random.default_rng(k)
        line = rng.integers(1, 9, rng.integers(3, 14)).astype(np.uint64)
        x, y = (np.concatenate([np.tile(line, 12), rng.integers(1, 60, 60).astype(np.uint64)])[rng.integers(0, 40) :] for _ in range(2))
        n, sets = 12, lambda u: {tuple(u[i : i + 12].tolist()): frozenset(u[i : i + 12].tolist()) for i in range(len(u) - 11)}
        want = {(a, b): len(u & v) for a, u in sets(x).items() for b, v in sets(y).items() if 100 * len(u & v) >= 75 * len(u | v)}
        got = {(tuple(x[i : i + n].tolist()), tuple(y[j : j + n].tolist())): c for i, j, c in compact_windows.near_windows(x, y, n, 75).tolist()}
        assert got == want
