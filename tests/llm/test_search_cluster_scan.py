"""Hard negatives, centroid clusters and licence scans against plain versions."""

import os
import random
import re

import duckdb
import numpy as np
import pytest

from tablewarden.llm import centroid_clusters, hard_negatives, licence_scan, queries

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, embedding array<float>, label int, score int, cluster string, rank int"


def floors(v, scale):
    return [int(np.floor(scale * float(np.float32(x)))) for x in v]


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def vectors(rng, n, dim=12, ties=True):
    rows = []
    for k in range(n):
        v = [float(np.float32(x)) for x in rng.normal(0, 0.3, dim)]
        if ties and k % 9 == 0:
            v = [0.25] * dim
        rows.append((k, v, int(rng.integers(0, 4)), 1, "x", 2))
    return rows


def plain_negatives(rows, anchor_every=10):
    one = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or not usable(v):
            continue
        key = ((label + 1) % 10 if i % 7 == 0 else label, floors(v, 256))
        one[i] = min(one.get(i, key), key)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, v) in one.items():
        if a % anchor_every:
            continue
        scored = sorted((-dot(v, w), b) for b, (_, w) in one.items() if b != a)
        positives = [(b, -s) for s, b in scored if one[b][0] == label][:5]
        for p, ps in positives:
            fit = [(b, -s) for s, b in scored if one[b][0] != label and 30 * ps <= -100 * s <= 90 * ps][:10]
            out += [(a, p, k, b, ps, s) for k, (b, s) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(1024, 8192), (3, 20)])
def test_hard_negatives_equal_brute_force(spark, blocks):
    rng = np.random.default_rng(5)
    rows = vectors(rng, 160)
    rows += [rows[20], rows[33], (20, rows[40][1], 3, 0, "y", 1), (None, rows[1][1], 1, 0, "", 0), (500, None, 1, 0, "", 0), (501, rows[2][1], None, 0, "", 0), (510, [float("nan")] * 12, 1, 0, "", 0),
             (520, [None] * 12, 1, 0, "", 0), (530, [float("inf")] * 12, 2, 0, "", 0), (540, [], 2, 0, "", 0), (550, rows[3][1][:5], 2, 0, "", 0), (560, rows[3][1] + [0.5] * 30, 2, 0, "", 0)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = hard_negatives.mine(df, hard_negatives.Mining(anchor_every=10, anchors_a_block=blocks[0], rows_a_block=blocks[1])).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows)
    assert len(got) > 300


def test_bounds_hold_and_prune():
    """Summaries of clustered vectors leave few of them to be scored, and never drop one of the best."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-400, 400, (40, 1)) * np.ones((1, 64), np.int64)
    v = (np.repeat(centres, 50, 0) + rng.integers(-3, 4, (2000, 64))).astype(np.int64)
    batch = hard_negatives.pa.record_batch({"vec_id": np.arange(2000), "label": np.zeros(2000, np.int64), "v": hard_negatives.pa.array(v.tolist(), hard_negatives.pa.list_(hard_negatives.pa.int64()))})
    t = hard_negatives.pa.Table.from_batches(list(hard_negatives.summaries([batch])))
    a, b = hard_negatives.both(t.slice(0, 5), t)
    for i in range(5):
        score = v @ v[i]
        want = np.lexsort((np.arange(2000), -score))[:10]
        (at, found), = hard_negatives.best(a, i, b, np.arange(2000), [(None, None)], 10)
        assert at.tolist() == want.tolist() and found.tolist() == score[want].tolist()
        wide, mean, spread = b.levels[0]
        middle, reach = wide * (mean @ a.levels[0][1][i]), spread @ a.levels[0][2][i] + 1e-6
        assert (abs(score - middle) <= reach).all()
        assert ((middle + reach) >= np.sort(middle - reach)[-10]).sum() < 500


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(100, [1.0], 1, 0, "", 0)], VECTORS)).count() == 0


def test_scores_beyond_a_long_are_an_error(spark):
    df = spark.createDataFrame([(100, [1e15], 1, 0, "", 0), (2, [1e15], 1, 0, "", 0)], VECTORS)
    with pytest.raises(Exception, match="might leave a long"):
        hard_negatives.mine(df).count()


def plain_clusters(rows, k=16, rounds=3, dim=64):
    import hashlib

    kept = [(i, floors(v, 64)) for i, v, *_ in rows if usable(v) and len(v) == dim]
    name = lambda i: (i is None, "" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((square(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centroids)]
    last = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in last)
    per = {n: sum(d for _, d, m in last if m == n) for n in range(len(centroids))}
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, per[n], total, text[n]) for i, d, n in last), key=str)


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = vectors(rng, 200, 64)
    rows = [(i, [round(x * 4) / 64 for x in v] if i % 2 else v, *r) for i, v, *r in rows]  # many equal distances
    rows += [rows[7]] * 3 + [(None, rows[5][1], 1, 0, "", 0), (900, None, 1, 0, "", 0), (901, rows[5][1][:63], 1, 0, "", 0), (902, [float("nan")] * 64, 1, 0, "", 0), (903, [None] * 64, None, 0, "", 0), (904, [], 1, 0, "", 0), (905, [-0.01] * 64, None, 0, "", 0)]
    got = centroid_clusters.cluster(spark.createDataFrame(rows, VECTORS).repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == plain_clusters(rows)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(k, [float(k % 2)] * 64, 1, 0, "", 0) for k in range(5)]
    got = centroid_clusters.cluster(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(map(tuple, got), key=str) == plain_clusters(rows)
    assert centroid_clusters.cluster(spark.createDataFrame([], VECTORS)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_tree_search_finds_the_nearest_and_passes_over_others(seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(-9, 10, (16, 3)) if seed % 2 else np.repeat(rng.integers(-900, 901, (8, 64)), 2, 0)
    tree = centroid_clusters.build(points.astype(np.int64))
    v = np.concatenate([rng.integers(-9, 10, (300, points.shape[1])), points, points[rng.integers(0, 16, 300)] + rng.integers(-1, 2, (300, points.shape[1]))]).astype(np.int64)
    d = ((v[:, None, :] - points[None]) ** 2).sum(2)
    number, best = centroid_clusters.nearest(tree, v)
    assert (number == d.argmin(1)).all() and (best == d.min(1)).all()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.execute(queries.SQL[name]).fetchdf()
    plain = lambda f: sorted(map(str, f[sorted(f.columns)].astype(object).values.tolist()))
    assert plain(got) == plain(want)


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PLAIN = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def places(text, phrases=PLAIN):
    w = WORD.findall(lowered(text))
    return len(w), sorted((k, p) for p in phrases for k in range(len(w)) if w[k : k + len(p.split())] == p.split())


def plain_best(text, notices, least=3):
    """Coverage of the longest single match with any notice."""
    w, best = WORD.findall(lowered(text)), 0.0
    for _, notice in notices:
        n = WORD.findall(lowered(notice))
        for i in range(len(w)):
            for j in range(len(n)):
                k = 0
                while i + k < len(w) and j + k < len(n) and w[i + k] == n[j + k]:
                    k += 1
                if k >= least:
                    best = max(best, k / len(n))
    return best


def texts():
    rng = random.Random(4)
    pool = "cc by nc general public license all rights reserved under the gnu mit apache lesser of and ß Ü 4 0".split()
    out = [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 40))) for _ in range(150)]
    out += [None, "", " \n", "CC-BY", "cc\tby nc", "CC BY CC BY cc by", "General\nPublic. License", "All rights reſerved", "K all rights reserved", "xcc by", "cc byx", "cc", "All Rights Reserved." * 5000, "a" * 300000, "cc by " * 40000]
    return out


def test_phrases_and_matches_equal_brute_force(spark):
    data = texts()
    df = spark.createDataFrame([(k, t, "x", 7) for k, t in enumerate(data)], "doc_id bigint, text string, labels string, score int").repartition(3)
    scanner = licence_scan.Scanner(gap=-1)  # no chains of several matches, so that best is one match's coverage
    found = {r["doc_id"]: r for r in licence_scan.scan(df, scanner).collect()}
    short = {r["doc_id"]: r for r in licence_scan.report(df).collect()}
    assert len(found) == len(short) == len(data)
    for k, t in enumerate(data):
        n, want = places(t)
        assert found[k]["n_words"] == short[k]["n_words"] == n
        assert sorted((p["word"], p["phrase"]) for p in found[k]["phrases"]) == want
        assert (short[k]["n_base"], short[k]["first_word"], short[k]["last_word"]) == (len(want), want[0][0] if want else None, want[-1][0] if want else None)
        assert short[k]["base_labels"] == ",".join(sorted({PLAIN[p] for _, p in want}))
        assert set(short[k]["base_labels"].split(",")) - {""} <= set(short[k]["labels"].split(","))
        assert 0 <= short[k]["score"] <= 1 and (not want or short[k]["score"] == 1)
        if n < 60:
            assert found[k]["best"] == pytest.approx(plain_best(t, scanner.notices))


def test_changed_notices_are_found(spark):
    mit = dict(licence_scan.NOTICES[::-1])["mit"]
    long = [t for label, t in licence_scan.NOTICES if label == "mit"][2].split()
    broken = " ".join(w if k % 17 else "zzz" for k, w in enumerate(long))
    data = [f"some words before {broken} and after", "released under the MIT License.", "This work is licensed under the GNU General Public License, version 3", "licensed under CC BY-NC 4.0", " ".join(long[:40]), "under the blue licence of mit", mit]
    got = [r["labels"] for r in licence_scan.report(spark.createDataFrame(list(enumerate(data)), "doc_id bigint, text string").coalesce(1)).orderBy("doc_id").collect()]
    assert got == ["mit", "mit", "gpl", "cc-by,cc-by-nc", "", "", "mit"]


def test_matching_statistics_equal_brute_force():
    rng = random.Random(8)
    for _ in range(40):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(4)]
        text = [rng.randrange(4) for _ in range(40)]
        inside = lambda x: any(s[i : i + len(x)] == x for s in sequences for i in range(len(s)))
        a = licence_scan.Automaton(sequences)
        for k, (state, length) in enumerate(a.walk(text)):
            want = max(n for n in range(k + 2) if n == 0 or inside(text[k + 1 - n : k + 1]))
            assert length == want
            x = text[k + 1 - length : k + 1]
            assert not length or a.ends[state] == {(t, i + length - 1) for t, s in enumerate(sequences) for i in range(len(s)) if s[i : i + length] == x}


def test_scan_of_no_rows(spark):
    assert licence_scan.report(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
