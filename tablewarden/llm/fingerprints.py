"""Document fingerprints as invertible Bloom lookup sketches, with DataFrame functions only.

A document is the set of digests of its paragraphs: lines, cut further after two sentences
(of 200 letters at most); a repeated paragraph counts with its number of occurrence. A sketch
is `CELLS` cells in three tables; each digest is added to one cell of each table (count,
xor of digests, xor of checks). Sketches of two versions are subtracted cell by cell, and
peeling recovers the digests that differ: a cell with count 1 or -1 and a right check holds
one digest alone, which is then taken from its other cells. If cells remain, both versions
are sketched larger (the digests dealt to more sketches by their low bits) and peeled again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import tasks

WIDTH = 8  # cells of a table
CELLS = 3 * WIDTH
ROUNDS = 12  # of peeling; no sketch of CELLS cells that peels at all needs more
LOAD = 9  # digests to a sketch at the first larger size
PARAGRAPH = r"[^\n.!?]{1,200}[.!?]*(?:[^\n.!?]{1,200}[.!?]*)?\n*|[.!?\n]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digests(text: Column) -> Column:
    """Sorted 64-bit digests of the paragraphs of a text; null or empty: none."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))
    hashes = F.sort_array(F.transform(parts, lambda p: F.xxhash64(p)))

    def numbered(hs: Column) -> Column:
        """Equal hashes stand side by side: from where each run of them starts follow its repeats' numbers, in time linear in the text."""
        starts = F.filter(F.transform(hs, lambda h, i: F.when((i == 0) | (F.get(hs, i - 1) != h), i)), lambda i: i.isNotNull())
        repeats = lambda at, end: F.transform(F.sequence(F.lit(0), end - at - 1), lambda n: F.xxhash64(F.get(hs, at), n.cast("long")))
        return let(starts, lambda ss: F.flatten(F.transform(ss, lambda at, j: repeats(at, F.coalesce(F.get(ss, j + 1), F.size(hs))))))

    return let(hashes, numbered)


def check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(7)).bitwiseAND(F.lit(0xFFFFFFFF))


def cell_of(key: Column, table: int) -> Column:
    return F.shiftrightunsigned(key, 20 + 8 * table).bitwiseAND(F.lit(WIDTH - 1)).cast("int")


def _cell(n: Column, key: Column, proof: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), key.alias("key"), proof.alias("proof"))


def placed(keys: Column) -> Column:
    """Each digest with its check and its cells, worked out once."""
    return F.transform(keys, lambda k: F.struct(k.alias("key"), check(k).alias("proof"), *(cell_of(k, j).alias(f"at{j}") for j in range(3))))


def sketch(keys: Column) -> Column:
    """The CELLS cells of a set of placed digests."""
    empty = lambda: _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))

    def table(ks: Column, at: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda c: F.aggregate(
            F.filter(ks, lambda k: k[at] == c), empty(), lambda a, k: _cell(a["n"] + 1, a["key"].bitwiseXOR(k["key"]), a["proof"].bitwiseXOR(k["proof"]))))

    return let(keys, lambda ks: F.concat(*(table(ks, f"at{j}") for j in range(3))))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["key"].bitwiseXOR(y["key"]), x["proof"].bitwiseXOR(y["proof"])))


def peel(cells: Column) -> Column:
    """Struct of ok (nothing is left) and found: the recovered digests, each with sign s (1: only in the first version)."""

    def pure(cs: Column) -> Column:
        alone = F.filter(cs, lambda c: (F.abs(c["n"]) == 1) & (check(c["key"]) == c["proof"]))
        return F.array_distinct(F.transform(alone, lambda c: F.struct(
            c["n"].alias("s"), c["key"].alias("key"), c["proof"].alias("proof"), *((cell_of(c["key"], j) + j * WIDTH).alias(f"at{j}") for j in range(3)))))

    def without(cs: Column, found: Column) -> Column:
        return F.transform(cs, lambda c, i: F.aggregate(
            F.filter(found, lambda p: (p["at0"] == i) | (p["at1"] == i) | (p["at2"] == i)), c,
            lambda a, p: _cell(a["n"] - p["s"], a["key"].bitwiseXOR(p["key"]), a["proof"].bitwiseXOR(p["proof"]))))

    def one_round(state: Column, _: Column) -> Column:
        def after(found: Column) -> Column:
            brief = F.transform(found, lambda p: F.struct(p["s"].alias("s"), p["key"].alias("key")))
            return F.when(F.size(found) == 0, state).otherwise(F.struct(without(state["cells"], found).alias("cells"), F.concat(state["found"], brief).alias("found")))

        return let(pure(state["cells"]), after)

    start = F.struct(cells.alias("cells"), F.array().cast("array<struct<s:int,key:bigint>>").alias("found"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one_round)
    return let(done, lambda s: F.struct((~F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["proof"] != 0))).alias("ok"), s["found"].alias("found")))


def recovered(x: Column, y: Column, at: int, retries: int) -> Column:
    """How many digests differ between two small placed sets; a sketch that does not peel is retried as four, by the next two bits. Null: not even the last size peeled."""

    def again(found: Column) -> Column:
        if not retries:
            return F.when(found["ok"], F.size(found["found"]))
        part = lambda keys, g: F.filter(keys, lambda k: F.shiftrightunsigned(k["key"], at).bitwiseAND(F.lit(3)) == g)
        four = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda g: recovered(part(x, g), part(y, g), at + 2, retries - 1))
        return F.when(found["ok"], F.size(found["found"])).otherwise(F.aggregate(four, F.lit(0), lambda t, n: t + n))

    return let(peel(subtract(sketch(x), sketch(y))), again)


def likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with `name`: 1 - (digests that differ) / (digests of both), by columns a and b of placed digests; two empty documents: 1.

    The fingerprints are subtracted and peeled first. If that fails, the digests are dealt
    by their bits to so many sketches that about LOAD come to each, and a sketch that still
    fails is retried larger. Should the last size fail too, the digest sets are compared.
    """
    both = F.size(a) + F.size(b)
    small = F.when(F.abs(F.size(a) - F.size(b)) > CELLS, None).otherwise(let(peel(subtract(sketch(F.col(a)), sketch(F.col(b)))), lambda p: F.when(p["ok"], F.size(p["found"]))))
    bits = F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.lit(2.0), both / LOAD)))).cast("int")

    def dealt(b_: Column) -> Column:
        first = F.floor(b_ / 2).cast("int")
        mask = lambda n: F.element_at(F.array(*(F.lit((1 << i) - 1).cast("long") for i in range(32))), n + 1)
        low = lambda keys, m: lambda g: F.filter(keys, lambda k: k["key"].bitwiseAND(m) == g)
        high = lambda keys, m, over: lambda g: F.filter(keys, lambda k: F.floor(k["key"].bitwiseAND(F.lit((1 << 32) - 1)) / over).cast("long").bitwiseAND(m) == g)
        zero = F.lit(0).cast("long")
        rough = let(mask(first), lambda m: F.transform(F.sequence(zero, m), lambda g: F.struct(low(F.col(a), m)(g).alias("x"), low(F.col(b), m)(g).alias("y"))))
        fine = let(mask(b_ - first), lambda m: let(mask(first) + 1, lambda over: F.flatten(F.transform(rough, lambda p: F.transform(F.sequence(zero, m), lambda g: F.struct(high(p["x"], m, over)(g).alias("x"), high(p["y"], m, over)(g).alias("y")))))))
        return F.aggregate(F.transform(fine, lambda p: recovered(p["x"], p["y"], 44, 2)), F.lit(0), lambda t, n: t + n)

    df = df.withColumn("_small", small)
    df = df.withColumn("_count", F.when(F.col("_small").isNotNull(), F.col("_small")).otherwise(let(bits, dealt)))
    plain = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    last = F.when(F.col("_count").isNotNull(), F.col("_count")).otherwise(plain)
    return df.withColumn(name, F.when(both == 0, 1.0).otherwise(1 - last / both)).drop("_small", "_count")


def fingerprint(keys: Column) -> Column:
    """The sketch of placed digests as a string: count, digest and check of every cell in hexadecimal."""
    text = lambda c: F.concat(F.hex(c["n"].cast("long")), F.lit(":"), F.hex(c["key"]), F.lit(":"), F.hex(c["proof"]))
    return F.array_join(F.transform(sketch(keys), text), " ")


def with_next(docs: DataFrame, order: str, carried: list[str]) -> DataFrame:
    """Each row with next_<c> of the row that follows in ascending order (the first after the last), without a global sort.

    Rows fall into ranges of about equal size; the first row of a range is also sent, as an
    edge, to the range before it. Only the bounds of the ranges pass through the driver.
    """
    spark = docs.sparkSession
    n = min(8 * tasks(spark), 20_000)
    key = F.coalesce(F.col(order).cast("long"), F.lit(-(2**63)).cast("long"))
    bounds = docs.select(key.alias("k")).agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    bounds = sorted(set(bounds))
    table = F.from_json(F.lit(str(bounds)), "array<bigint>")
    steps = [1 << s for s in reversed(range(max(1, len(bounds).bit_length())))]
    place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.get(table, at + s - 1) < F.col("_k")), at + s).otherwise(at))
    rows = docs.withColumn("_k", key).withColumn("_range", place)
    firsts = rows.groupBy("_range").agg(F.min("_k").alias("_k"))  # one row per range
    ring = Window.orderBy("_range")
    edges = firsts.select("_k", F.coalesce(F.lag("_range").over(ring), F.max("_range").over(Window.partitionBy())).alias("_before"))
    rows = rows.join(F.broadcast(edges), "_k", "left").withColumn("_to", F.explode(F.when(F.col("_before").isNull(), F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("edge"))))
        .otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("edge")), F.struct(F.col("_before").alias("r"), F.lit(True).alias("edge"))))))
    line = Window.partitionBy("_to.r").orderBy("_to.edge", "_k", "_tie")
    follow = rows.withColumn("_tie", F.xxhash64(*carried)).withColumns({f"next_{c}": F.lead(c).over(line) for c in carried})
    return follow.where("not _to.edge").drop("_k", "_range", "_before", "_to", "_tie")


def edited(text: Column, following: Column) -> Column:
    """The last floor(n/4) code points replaced by the first as many (or all) of the following text."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(following, F.lit(1), quarter))


def compare_versions(docs: DataFrame) -> DataFrame:
    """For every row of docs (doc_id, text) its fingerprint, that of its edited text, and likenesses to that and to the next document.

    Null texts are empty; a null doc_id comes before all others; repeated rows follow each
    other; the only row of a table is its own next. Other columns are ignored. An empty
    table gives an empty result.
    """
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("keys", digests(F.col("text")))
    pairs = with_next(rows, "doc_id", ["text", "keys"])
    versions = pairs.withColumn("edited_text", edited(F.col("text"), F.col("next_text"))).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"), "keys", "next_keys", digests(F.col("edited_text")).alias("edited_keys"))
    versions = versions.withColumns({c: placed(F.col(c)) for c in ("keys", "edited_keys", "next_keys")})
    scored = likeness(likeness(versions, "keys", "edited_keys", "near_edited"), "keys", "next_keys", "near_next")
    return scored.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("keys")).alias("fingerprint"), fingerprint(F.col("edited_keys")).alias("edited_fingerprint"), "near_edited", "near_next")
