"""The dealt operators on small tables with odd rows, against brute force."""

import base64
import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tablewarden.llm import compact_windows, fingerprints, jaccard_join, nn_descent, packing, piece_coder, recurrent_lm, suffix_dedup, toxicity, warc
from tablewarden.llm.queries import token_file

LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
RNG = np.random.default_rng(3)
VOCAB = ["".join(RNG.choice(list("abcdeö"), RNG.integers(2, 7))) for _ in range(400)]


def prose(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(VOCAB, n)) + ("." if n else "")


def words(text):
    return (text or "").encode().translate(LOWER).split()


BASE = prose(200, 1)
TEXTS = [
    None, "", "   \n", "one", BASE, BASE, BASE + " tail", prose(120, 2) + "\n" + BASE[:400], BASE.replace(VOCAB[3], "changed"), prose(5, 4), prose(4, 5), prose(4, 5),
    "x" * 200, "x" * 120, prose(3000, 6), "Ünïcödé 😀 " * 30, prose(60, 7) + "\n\n" + prose(60, 8), prose(60, 8).upper(), "a b\tc\x0bd e f g h",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", f"src{i % 2}", 7, 1.5) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, source string, n long, score double").repartition(3)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_empty_tables(spark, docs):
    none = docs.where("false")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert fingerprints.compare_versions(none).count() == 0
    assert jaccard_join.near_duplicates(none).count() == 0
    assert compact_windows.near_passages(none).count() == 0
    assert suffix_dedup.dedup(none).count() == 0
    assert packing.pack(none, token_file("byte_bpe_50k.json")).count() == 0
    assert toxicity.toxicity(none, labels).count() == 0
    assert recurrent_lm.score_documents(none).count() == 0
    assert piece_coder.code_documents(none, token_file("piece_bpe_32k.model")).count() == 0
    assert nn_descent.nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert warc.archive_report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_fingerprints(docs):
    got, last = by_id(fingerprints.compare_versions(docs)), len(TEXTS)
    parts = lambda t: Counter(re.findall(fingerprints.PARAGRAPH, t))

    def like(a, b):
        a, b = parts(a), parts(b)
        n = sum(a.values()) + sum(b.values())
        return 1.0 if not n else 1 - (sum((a - b).values()) + sum((b - a).values())) / n

    for i, t in enumerate(TEXTS):
        t, after = t or "", TEXTS[(i + 1) % last] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["near_edited"] == pytest.approx(like(t, edited)) and got[i]["near_next"] == pytest.approx(like(t, after))
    assert got[4]["fingerprint"] == got[5]["fingerprint"] != got[6]["fingerprint"]


def shingle_set(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_components(spark, docs):
    near = [(100 + k, BASE + " " + prose(k % 70, 100 + k), "", "", 0, 0.0) for k in range(90)]
    table = docs.unionByName(spark.createDataFrame([*near, (None, BASE, "", "", 0, 0.0)], docs.schema))
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    sets, parent = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    want = sorted((str(i), len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows))
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(table).collect())
    assert got == want


def test_jaccard_components_of_copies_far_from_each_other(spark):
    """Copies of one original with many changes, linked through it alone, beside outliers linked with nobody."""
    rng = np.random.default_rng(12)
    base = prose(150, 60).split()

    def changed(many):
        out = list(base)
        for k in rng.choice(len(base), many, replace=False):
            out[k] = VOCAB[int(rng.integers(0, 12))] + "q"
        return " ".join(out)

    rows = [(i, changed(int(n))) for i, n in enumerate(rng.integers(1, 9, 160))] + [(500, " ".join(base)), (501, " ".join(base[:130])), (502, " ".join(base[10:] + prose(12, 61).split()))]
    sets, parent = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in itertools.combinations(range(len(rows)), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: least[find(k)] for k, (i, _) in enumerate(rows)} and 10 < len(set(got.values())) < 150


def test_suffix_dedup(docs):
    got, seen = by_id(suffix_dedup.dedup(docs, keep_text=True)), set()
    for i, t in enumerate(TEXTS):
        b = (t or "").encode()
        grams = [b[k : k + 50] for k in range(len(b) - 49)]
        mark = np.zeros(len(b) + 1, int)
        for k, g in enumerate(grams):
            if g in seen:
                mark[k] += 1
                mark[k + 50] -= 1
        seen.update(grams)
        gone = np.cumsum(mark)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), i
        assert r["text"] == (None if t is None else kept.decode("utf-8", "ignore")) and r["key"] == "clash"


def test_suffix_dedup_beside_clashing_columns(spark):
    shared = prose(40, 77)
    table = spark.createDataFrame([(1, shared, "a", 5), (2, "x " + shared, "b", 6)], "doc_id long, text string, _id string, n_bytes int").selectExpr("*", "1 as _own0", "2 as _set1", "3 as _OWN1")
    assert sorted(r["n_removed"] > 0 for r in suffix_dedup.dedup(table).collect()) == [False, True]
    plain = suffix_dedup.dedup(table, keep_text=True, report=False)
    assert plain.columns == table.columns and {(r["_id"], r["n_bytes"], r["_OWN1"]) for r in plain.collect()} == {("a", 5, 3), ("b", 6, 3)}


def test_suffix_arrays_against_brute_force():
    import pyarrow as pa

    texts = [(int(d), bytes(RNG.integers(0, 2, int(n)).astype(np.uint8))) for d, n in zip(RNG.integers(0, 40, 300), RNG.integers(4, 14, 300))]  # bytes 0 and 1: ends that are all NUL
    batches = [pa.record_batch([pa.array([0] * len(part), pa.int32()), pa.array([d for d, _ in part], pa.int64()), pa.array([t for _, t in part], pa.binary())], ["place", "doc_id", "text"])
               for part in (texts[k : k + 25] for k in range(0, 300, 25))]
    least, owned = {}, set()
    for d, t in texts:
        for k in range(len(t) - 3):
            least[t[k : k + 4]] = min(d, least.get(t[k : k + 4], d))
            owned.add((d, t[k : k + 4]))
    name = lambda g: suffix_dedup.digests(np.frombuffer(g, np.uint8), np.array([0]), np.array([4])).view(np.int64).tolist()
    want = {(d, *name(g)) for d, g in owned if least[g] < d}
    got = {tuple(r.values()) for b in suffix_dedup.suffix_arrays(iter(batches), 4) for r in b.to_pylist()}
    assert got == want and len(want) > 100


def test_repeats_in_other_surroundings(spark):
    """A passage that every document holds between texts of its own, several times, and rows of one doc_id."""
    shared = prose(30, 5)
    rows = [(i, f"{prose(12, 100 + i)} {shared} {prose(9, 300 + i)} {shared}") for i in range(60)] + [(7, shared), (70, shared), (71, shared[:49]), (72, "\0" * 60), (73, "\0" * 55)]
    got = {(r["doc_id"], r["n_bytes"]): r for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), keep_text=True).collect()}
    for i, t in rows:
        b, mark = t.encode(), np.zeros(len(t.encode()), bool)
        earlier = {u.encode()[k : k + 50] for j, u in rows if j < i for k in range(len(u.encode()) - 49)}
        for k in range(len(b) - 49):
            if b[k : k + 50] in earlier:
                mark[k : k + 50] = True
        assert got[i, len(b)]["text"] == np.frombuffer(b, np.uint8)[~mark].tobytes().decode(), i


def test_levels_merge_geometrically():
    family, owner = suffix_dedup.Levels(), {}
    for turn in range(40):
        keys = np.unique(RNG.integers(0, 500, 30)).astype(np.uint64)
        docs = RNG.integers(0, 1000, len(keys))
        lost_docs, lost_keys = family.add(keys, docs, np.zeros(len(keys), np.uint32))
        lost = set(zip(lost_keys.tolist(), lost_docs.tolist()))
        for k, d in zip(keys.tolist(), docs.tolist()):
            if k in owner and owner[k] != d:
                assert (k, max(owner[k], d)) in lost
            owner[k] = min(owner.get(k, d), d)
    key, doc, _ = family.all()
    assert dict(zip(key.tolist(), doc.tolist())) == owner and len(family.levels) <= 9


def test_least_vector_of_one_id(spark):
    """Of different vectors under one vec_id the least by its components counts, whatever the order of rows."""
    rows = [(0, [1.0, 0.0]), (1, [9.0, 9.0]), (1, [1.0, 1.0]), (2, [1.0, 3.0])]
    for order in (rows, rows[::-1]):
        got = nn_descent.nearest_neighbours(spark.createDataFrame(order, "vec_id long, embedding array<float>").repartition(3), k=2).collect()
        assert [(r["query_id"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1.0), (0, 2, 3.0)]


def test_fingerprints_number_repeats(spark):
    """Repeated paragraphs get the numbers that searching for the first of them gives; 50,000 equal lines in 2 MB of text take linear time."""
    from pyspark.sql import functions as F

    texts = ["", "a\n" * 7, "x. y. x. y. x. y.\n" * 5, *("".join(RNG.choice(["one\n", "two\n", "three. four.\n"], 40)) for _ in range(20))]
    plain = F.sort_array(F.transform(F.regexp_extract_all("text", F.lit(fingerprints.PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))
    searched = F.transform("h", lambda h, i: F.xxhash64(h, F.when(F.get("h", i - 1) == h, i + 1 - F.array_position("h", h)).otherwise(0)))
    table = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("h", plain)
    for r in table.select(searched.alias("want"), fingerprints.digests(F.col("text")).alias("got")).collect():
        assert sorted(r["want"]) == sorted(r["got"]) and len(set(r["got"])) == len(r["got"])
    long = "the same line\n" * 50_000 + "".join(f"{k} stands for itself in a line of its own\n" for k in range(30_000))
    found = spark.createDataFrame([(long,)], "text string").select(F.size(fingerprints.digests(F.col("text"))), F.size(F.array_distinct(fingerprints.digests(F.col("text"))))).first()
    assert len(long) > 1_900_000 and tuple(found) == (80_000, 80_000)


def test_packing(docs):
    from tokenizers import Tokenizer

    rows = packing.pack(docs, token_file("byte_bpe_50k.json")).toPandas()
    model = Tokenizer.from_file(token_file("byte_bpe_50k.json"))
    for i, t in enumerate(TEXTS):
        ids = np.array(model.encode(t or "", add_special_tokens=False).ids + [2], np.uint32)
        own = rows[rows.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length[1:] == 1024).all() and own.length.max() <= 1024
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    for _, bin_ in rows.sort_values("offset").groupby("sequence_id"):
        assert (bin_.length.cumsum() - bin_.length == bin_.offset).all() and bin_.length.sum() <= 1024


def test_ids_are_those_of_the_tokenizers_library():
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    path = token_file("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()]
    texts += ["a" + " " * 1_000_000 + "b", "\n" * 1_000_000, "ab" * 300_000, "!" * 3999, "1" * 3999, " " * 399 + "x", "\t \n" * 133, "don't I'LL we've", "<|endoftext|> x"]
    for i in range(0, len(texts), 500):
        want = model.encode_batch(texts[i : i + 500], add_special_tokens=False)
        assert all(got.tolist() == w.ids for got, w in zip(packing.encode(path, texts[i : i + 500]), want)), i


def test_fullest_bin_and_patterns():
    for _ in range(60):
        counts = {int(k): int(RNG.integers(1, 4)) for k in RNG.integers(1, 40, 4)}
        items = [k for k, n in counts.items() for _ in range(n)]
        room = int(RNG.integers(5, 60))
        best = max(s for n in range(len(items) + 1) for c in itertools.combinations(items, n) if (s := sum(c)) <= room)
        found = packing.fullest(counts, room)
        assert sum(found) == best and not Counter(found) - Counter(items)
    histogram = {int(k): int(n) for k, n in zip(RNG.integers(1, 1025, 60), RNG.integers(1, 500, 60))}
    used = Counter()
    for pattern, times in packing.bin_patterns(histogram, 1024):
        assert sum(pattern) <= 1024
        for k in pattern:
            used[k] += times
    assert used == Counter(histogram)


def test_toxicity_learns_and_ignores_held_out(spark):
    bad = ["scoundrel", "blockhead"]
    rows = [(i, prose(40, i) + (" " + bad[i % 2] if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(400)]
    table = spark.createDataFrame([*rows, (None, "x", 0), (900, None, 0), (900, None, 0)], "doc_id long, text string, toxic int")
    labels = table.select("doc_id", "toxic").union(spark.createDataFrame([(5, None), (7, 9)], "doc_id long, toxic int"))
    out = toxicity.toxicity(table.withColumnRenamed("toxic", "score"), labels).toPandas()
    assert len(out) == 403 and out.score.between(0, 1).all() and set(out.predicted) <= {0, 1}
    held = out[out.held_out].merge(table.toPandas().dropna(), on="doc_id")
    assert len(held) > 60 and (held.predicted == held.toxic).mean() > 0.95
    flipped = labels.withColumn("toxic", (1 - labels["toxic"]).cast("int")).where(toxicity.held_out()).union(labels.where(~toxicity.held_out()))
    again = toxicity.toxicity(table.withColumnRenamed("toxic", "score"), flipped).toPandas()
    assert sorted(map(str, again.values.tolist())) == sorted(map(str, out.values.tolist()))
    copies = table.select("doc_id", "text").unionByName(table.where("doc_id < 30").selectExpr("doc_id", "concat(text, ' again') as text"))
    assert toxicity.labelled_sample(copies, labels, toxicity.Settings(max_rows=20)).count() <= 20
    alone = toxicity.toxicity(table.select("doc_id", "text"), labels.where("false")).toPandas()
    assert (alone.score == 0.5).all()


def test_recurrent_lm(spark):
    rows = [(i, " ".join((["the", "cat", "sat", "on"] if i % 2 else ["le", "chat", "est", "la"]) * 30) + (f" rare{i}" if i % 5 == 0 else "")) for i in range(300)]
    table = spark.createDataFrame([*rows, (400, None), (401, ""), (401, ""), (None, "the cat")], "doc_id long, text string").repartition(4)
    out = recurrent_lm.score_documents(table, recurrent_lm.Settings(head=64, members=16, tails=8)).toPandas()
    texts = [(r["doc_id"], words(r["text"])) for r in table.collect()]
    train = Counter(w for i, ws in texts if i is None or zlib.crc32(str(i).encode()) % 10 for w in [*ws, None])
    total = sum(train.values())
    assert len(out) == len(texts) and (out.train_tokens == total).all()
    got = {i: r for i, r in zip(out.doc_id, out.itertuples())}
    for i, ws in texts:
        if i is not None:
            base = sum(np.log10((train[w] + 0.1) / (total + 0.1 * (len(train) + 1))) for w in [*ws, None])
            assert got[i].base_score == pytest.approx(base) and got[i].n_tokens == len(ws) + 1 and got[i].n_known == sum(train[w] > 0 for w in [*ws, None])
    held = out[out.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_recurrent_lm_learns_from_every_training_document(spark):
    small = {"head": 64, "members": 16, "tails": 8}
    for seed in (31, 32, 33):
        table = spark.createDataFrame([(seed, prose(80, seed))], "doc_id long, text string")
        s = recurrent_lm.Settings(**small)
        lexicon = recurrent_lm.lexicon_of(recurrent_lm.word_counts(table.select("text")), 1, s)
        learned, fresh = recurrent_lm.learn(table, lexicon).w, recurrent_lm.Network(lexicon).w
        assert any((learned[k] != fresh[k]).any() for k in fresh)


def small_network(seed=0):
    s = recurrent_lm.Settings(head=6, members=4, tails=2, hidden=5, window=7)
    lex = recurrent_lm.Lexicon([(f"w{i}".encode(), 9 - i) for i in range(6)], 5, 60, 12, {0: (3, 2), 1: (4, 3), 2: (48, 7)}, s)
    net, rng = recurrent_lm.Network(lex), np.random.default_rng(seed)
    net.w = {k: x.astype(np.float64) + (rng.standard_normal(x.shape) * 0.3 if k != "member_bias" else 0) for k, x in net.w.items()}
    return net, rng


def test_recurrent_lm_is_a_distribution_and_learns_by_true_gradients():
    net, rng = small_network()
    states = rng.standard_normal((1, 5))
    every = np.array([*range(7), -1, -2])
    assert np.exp(net.log_probs(np.repeat(states, 9, 0), every)).sum() == pytest.approx(1.0)
    ids, first, zero = rng.integers(-2, 7, (4, 3)), np.ones(3, bool), np.zeros(5)

    def loss():
        st, _, _ = net.forward(ids, first, zero)
        return -net.log_probs(st.reshape(-1, 5), ids.ravel()).sum()

    st, f, _ = net.forward(ids, first, zero)
    _, grad, part = net.log_probs(st.reshape(-1, 5), ids.ravel(), True)
    net.backward(ids, st, f, part.reshape(4, 3, 5).copy(), grad)
    for name, x in net.w.items():
        for _ in range(6):
            at = tuple(int(rng.integers(0, n)) for n in x.shape)
            if name == "member_bias" and x[at] < -1e6:
                continue
            before = x[at]
            x[at] = before + 1e-5
            up = loss()
            x[at] = before - 1e-5
            down = loss()
            x[at] = before
            assert grad[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-5), name


def test_recurrent_lm_scores_as_a_plain_loop_over_each_document():
    net, rng = small_network(1)
    keep = 1 / (1 + np.exp(-net.w["gate"]))
    texts = [rng.integers(-2, 7, n) for n in (1, 40, 7, 8, 300, 3, 14, 1)]
    got = net.frozen().scores(np.concatenate(texts), np.array([len(x) for x in texts]))
    for x, score in zip(texts, got):
        state, total = np.zeros(5), 0.0
        for i in x.tolist():
            logits = state @ net.w["classes"] + net.w["class_bias"]
            total += logits[i // 4 if i >= 0 else net.lexicon.heads - 1 - i] - np.log(np.exp(logits).sum())
            if i >= 0:
                inner = state @ net.w["members"][i // 4] + net.w["member_bias"][i // 4]
                total += inner[i % 4] - np.log(np.exp(inner).sum())
            row = i if i >= 0 else 6 - i
            state = keep[row] * state + (1 - keep[row]) * net.w["candidate"][row]
        assert score == pytest.approx(total)


def test_recurrent_lm_does_not_depend_on_the_partitions(spark):
    rows = [(i, prose(5 + i % 60, 2000 + i)) for i in range(120)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    s = recurrent_lm.Settings(head=64, members=16, tails=8, shard_bytes=4000)
    one, two = (recurrent_lm.score_documents(table.repartition(n), s).toPandas().sort_values("doc_id").score.tolist() for n in (1, 5))
    assert one == pytest.approx(two, rel=1e-6)


def test_recurrent_lm_with_more_equally_frequent_words_than_are_kept(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(40 * i, 40 * i + 40))) for i in range(50)]
    counts = recurrent_lm.word_counts(spark.createDataFrame(rows, "doc_id long, text string").select("text"))
    lexicon = recurrent_lm.lexicon_of(counts, 50, recurrent_lm.Settings(frequent=500, head=64, members=16))
    assert 350 < len(lexicon.ids) < 650 and lexicon.total == 2050 and lexicon.distinct == 2001


def test_pieces_as_the_library(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_file("piece_bpe_32k.model"))
    got = by_id(piece_coder.code_documents(docs, token_file("piece_bpe_32k.model"), with_ids=True))
    for i, t in enumerate(TEXTS):
        assert got[i]["ids"] == model.encode(t or "") and got[i]["exact"], i


def test_near_passages(spark, docs):
    shared, other = prose(90, 50), prose(80, 51)
    near = " ".join(w if (k + 1) % 39 else "new" for k, w in enumerate(other.split()))
    more = [(200, prose(70, 52) + " " + shared + " " + prose(70, 53)), (201, prose(150, 54) + "\n" + shared), (202, prose(40, 55) + " " + other + " " + prose(40, 56)), (203, near + " " + prose(90, 57)), (None, shared), (204, prose(300, 58))]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    out = compact_windows.near_passages(table).toPandas()
    pairs = set(zip(out.doc_id, out.other_doc_id))
    assert {(5, 4), (201, 200), (203, 202)} <= pairs and 204 not in set(out.doc_id) and (out.similarity >= 0.75).all()
    hit = out[(out.doc_id == 201) & (out.other_doc_id == 200)]
    assert ((hit.start_word < 200) & (hit.end_word > 190)).any()


def test_near_passages_where_the_smaller_document_holds_it_twice(spark):
    rows = []
    for k in range(5):
        passage = prose(60, 700 + k)
        rows += [(10 * k, " ".join([prose(40, 710 + k), passage, prose(35 + k, 720 + k), passage, prose(40, 730 + k)])), (10 * k + 1, " ".join([prose(50, 740 + k), passage, prose(50, 750 + k)]))]
    out = compact_windows.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    for k in range(5):
        own = out[(out.doc_id == 10 * k + 1) & (out.other_doc_id == 10 * k)]
        for start in (40, 135 + k):  # both places in the smaller document, all but the outermost words
            assert ((own.start_word < 65) & (own.end_word > 95) & (own.other_start < start + 15) & (own.other_start > start - 40) & (own.other_end > start + 45)).any(), (k, start)


def test_near_passages_whose_only_partner_is_among_other_variants(spark):
    rows = []
    for k in range(9):
        base = prose(80, 800 + k).split()
        variants = [" ".join(f"own{k}x{v}" if i in (12 + 4 * v, 46 + 4 * v) else w for i, w in enumerate(base)) for v in range(7)]
        for i, v in enumerate([0, 1, 2, 3, 4, 5, 1]):
            rows.append((20 * k + i, " ".join([prose(60, 900 + 20 * k + 2 * i), variants[v], prose(60, 901 + 20 * k + 2 * i)])))
    out = compact_windows.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    pairs = set(zip(out.doc_id, out.other_doc_id))
    assert {(20 * k + 6, 20 * k + 1) for k in range(9)} <= pairs


def test_useful_stretches_hold_every_passage_that_can_have_a_partner():
    s, rng = compact_windows.Settings(size=2, words=6), np.random.default_rng(21)
    for _ in range(60):
        off = np.cumsum([0, *rng.integers(0, 25, 3)])
        h = rng.integers(1, 30, off[-1]).astype(np.uint64)
        first, of = compact_windows.firsts(h, off)
        assert (h[first][of] == h).all() and [len(set(h[i:j].tolist())) for i, j in zip(off[:-1], off[1:])] == np.histogram(first, off)[0].tolist()
        shared = (h * np.uint64(7) % np.uint64(10)) < int(rng.integers(3, 9))
        got = compact_windows.useful(h, off, shared, first, s)
        for i, j in zip(off[:-1], off[1:]):
            for a in range(i, j):
                for z in range(a + s.least, j + 1):
                    own = set(h[a:z].tolist())
                    if 100 * len(own & set(h[a:z][shared[a:z]].tolist())) >= s.percent * len(own):
                        assert got[a:z].all()


def test_wide_nodes():
    for _ in range(200):
        n, least = int(RNG.integers(1, 80)), int(RNG.integers(1, 12))
        h = (RNG.integers(1, 30, n) * (RNG.random(n) > 0.05)).astype(np.uint64)
        want = []
        for i in np.flatnonzero(h):
            a = z = i
            while a > 0 and h[a - 1] > h[i]:
                a -= 1
            while z < n - 1 and h[z + 1] >= h[i]:
                z += 1
            if z - a + 1 >= least:
                want.append((a, i, z))
        assert sorted(zip(*(x.tolist() for x in compact_windows.wide_nodes(h, least)))) == sorted(want)


def test_nearest_neighbours(spark):
    x = RNG.standard_normal((700, 12)).astype(np.float32)
    x[50:90] = x[0]  # copies
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + [(1000, None, 1), (1001, [0.0] * 12, 1), (1002, [float("nan")] * 12, 1), (1003, [1.0], 1), (1004, [None] * 12, 1), (3, [float(v) for v in x[3]], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    out = nn_descent.nearest_neighbours(table).toPandas()
    assert set(out.query_id) == set(range(0, 700, 100)) and (out.groupby("query_id").size() == 10).all()
    hit, d64 = 0, x.astype(np.float64)
    for q in range(0, 700, 100):
        d = np.sqrt(((d64 - d64[q]) ** 2).sum(1))
        d[q] = np.inf
        own = out[out.query_id == q].sort_values("rank")
        hit += len(set(np.lexsort((np.arange(700), d))[:10]) & set(own.vec_id))
        assert np.allclose(d[own.vec_id], own.score, rtol=1e-12)
        assert own[["score", "vec_id"]].values.tolist() == sorted(own[["score", "vec_id"]].values.tolist())
    assert hit >= 63
    assert nn_descent.nearest_neighbours(table.where("vec_id in (0, 1)")).count() == 1


def test_graph_beside_a_huge_vector_and_in_a_dense_group(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1601, 8))
    x[800:1600] = x[0] + 1e-3 * rng.standard_normal((800, 8))
    x[1600] = 1e4
    x = x.astype(np.float32).astype(np.float64)
    graph = nn_descent.build_graph(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "node long, v array<double>")).toPandas()
    around = {i: set(g) for i, g in graph.groupby("node")["other"]}
    for part in (range(1, 800, 8), range(800, 1600, 8)):
        hit = 0
        for i in part:
            d = ((x - x[i]) ** 2).sum(1)
            d[i] = np.inf
            hit += len(set(np.argsort(d)[:10].tolist()) & around.get(i, set()))
        assert hit >= 0.9 * 10 * len(part)


def test_archive(spark):
    rows = [(3, "http://a", "<p>x</p>", 1), (1, "http://b\r\nX: y", "<p>x</p>", 2), (2, None, None, 3), (7, "u", "", 4), (5, "u", "ñ" * 1000, 5), (5, "u", "ñ" * 1000, 5), (None, "u", "null id", 6)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, length int")
    path = warc.write_archive(table)
    out = {(r["page_id"], r["payload_bytes"]): r for r in warc.archive_report(table).collect()}
    for i, _, html, _ in rows:
        body = (html or "").encode()
        r = out[(i, len(body))]
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
    kinds = {k: (r["record_type"], r["refers_to"]) for (k, _), r in out.items()}
    assert kinds == {3: ("revisit", 1), 1: ("response", None), 2: ("response", None), 7: ("revisit", 2), 5: ("response", None), None: ("response", None)}
    records = warc.read_records(spark, path).collect()
    assert len({r["record_id"] for r in records}) == 7 and all(b"\r\nWARC-Date: 20" in bytes(r["header"]) for r in records)
    assert len(records) == 7 and all(bytes(r["record"]).startswith(b"WARC/1.1\r\n") and bytes(r["record"]).endswith(b"\r\n\r\n") for r in records)
    assert {bytes(r["payload"]).decode() for r in records} == {h or "" for _, _, h, _ in rows}
    assert spark.read.parquet(f"{path}/payloads").count() == 4


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, prose(30 + i % 50, 300 + i) + (" scoundrel blockhead" if i % 5 == 0 else ""), "en", "s", 1) for i in range(150)]
    rows += [(500 + k, rows[k + 1][1], "en", "s", 1) for k in range(3)] + [(600, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, int(r[0] % 5 == 0)) for r in rows if r[0] < 500], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)))
        left[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    clean = {r[0] for r in rows if r[0] % 5 or r[0] >= 500}
    assert clean <= left["toxicity"] and len(left["toxicity"]) < len(rows)
    assert not {501, 502} & left["ngram_jaccard_join"] and {1, 2, 3, 600} <= left["ngram_jaccard_join"]
    assert left["best_fit_packing"] == left["suffix_array_dedup"] == left["ngram_jaccard_join"]


def test_pipeline_stages_on_empty_tables_and_beside_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    shared = prose(80, 88)
    rows = [(1, shared, 0.5, 7, "g"), (2, prose(60, 89) + " " + shared, 0.25, 8, "h"), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, n_bytes int, component_id string").selectExpr("*", "'r' as _own0", "1 as predicted", "'k' as kind")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and {(r["doc_id"], r["score"], r["n_bytes"], r["component_id"], r["_own0"], r["predicted"], r["kind"]) for r in out.collect()} == {(i, x, n, c, "r", 1, "k") for i, _, x, n, c in rows}, name
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_pipeline_keeps_rows_of_null_and_repeated_doc_ids(spark):
    import corpus_pipeline

    texts = [prose(60, 1200 + k) for k in range(8)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[4]), (8, texts[4]), (9, texts[5]), (None, texts[5]), (10, None), (10, None), (11, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = sorted((str(r["doc_id"]), str(r["text"])) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect())
    want = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (9, texts[5]), (10, None), (11, ""), (None, None)]
    assert left == sorted((str(i), str(x)) for i, x in want)
