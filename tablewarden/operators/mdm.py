"""Entity resolution: blocked pairs, weighted scoring, components, golden records."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import matching_ratio
from ..functions.names import same, similarity
from ..functions.tiles import tile_scores
from ..sources.scratch import written

@dataclass(frozen=True)
class Match:
    """A column of a match: exact, fuzzy (edit distance) or blocks (matching blocks of letters, the row of the lesser key first)."""

    column: str
    weight: float = 1.0
    kind: str = "exact"
    threshold: float = 0.85


def match_table(profile: DataFrame, hints: DataFrame, default: float = 1.0, numeric: float = 1.5, threshold: float = 0.85) -> DataFrame:
    """(column, kind, weight, threshold, telling) for each row of a column profile, by hints (hint, weight, strong).

    A name with a strong hint matches exactly with its greatest weight; other texts match
    fuzzily with the default weight, other types exactly with the numeric one. telling is
    whether any hint is in the name.
    """
    named = profile.join(hints, F.contains(F.lower(F.col("column")), F.lower("hint")), "left").groupBy("column", "dtype").agg(F.max(F.when(F.col("strong"), F.col("weight"))).alias("sure"), F.count("hint").alias("hints"))
    text = F.col("dtype") == "string"
    kind = F.when(F.col("sure").isNull() & text, "fuzzy").otherwise("exact")
    weight = F.coalesce("sure", F.when(text, default).otherwise(numeric))
    return named.select("column", kind.alias("kind"), weight.alias("weight"), F.when(kind == "fuzzy", threshold).alias("threshold"), (F.col("hints") > 0).alias("telling"))


def chosen_matches(table: DataFrame, columns: list[str], most: int = 4, fallback: int = 3) -> list[Match]:
    """The first telling columns of a match table in the order of columns, else the first columns."""
    rows = {r["column"]: r for r in table.collect()}  # one row per column
    names = [c for c in columns if c in rows and rows[c]["telling"]][:most] or [c for c in columns if c in rows][:fallback]
    return [Match(c, rows[c]["weight"], rows[c]["kind"], rows[c]["threshold"] or 0.85) for c in names]


def tiled(df: DataFrame, key: str, block: str, rows_a_tile: int, pairs_a_task: int = 2_000_000) -> tuple[DataFrame, DataFrame, int, float]:
    """The two sides of a join of blocks with themselves, by (block, _i, _j): a block of many rows is cut into tiles by a hash of the key, and every two tiles meet once, under a key of their own.

    Then the number of tasks for the pairs, as few rows can make many of them, and the mean pairs of a block.
    """
    rows = df.where(F.col(block).isNotNull())
    sizes = rows.groupBy(F.col(block).alias("_large")).agg(F.count("*").alias("_n"))
    met = sizes.agg(F.sum(F.col("_n").cast("double") * F.col("_n")).alias("pairs"), F.max("_n").alias("most"), F.count("*").alias("blocks")).first()
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(10_000, int((met["pairs"] or 0) / 2 / pairs_a_task)))
    tiles, tile = F.lit(1), F.lit(0)
    if (met["most"] or 0) > rows_a_tile:
        large = written(sizes.where(F.col("_n") > rows_a_tile).select("_large", F.ceil(F.col("_n") / rows_a_tile).cast("int").alias("_tiles")))
        few = large.count() <= 100_000
        rows = rows.join(F.broadcast(large) if few else large, rows[block] == large["_large"], "left").drop("_large")
        tiles = F.coalesce("_tiles", F.lit(1))
        tile = F.pmod(F.xxhash64(key), tiles).cast("int")
    rows = rows.withColumns({"_t": tile, "_of": tiles}).drop("_tiles")
    left = rows.withColumn("_j", F.explode(F.sequence(F.col("_t"), F.col("_of") - 1))).withColumnRenamed("_t", "_i").drop("_of")
    right = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_t")))).withColumnRenamed("_t", "_j").drop("_of")
    return left, right, tasks, (met["pairs"] or 0) / 2 / max(1, met["blocks"])


def candidate_pairs(df: DataFrame, key: str, block: str | None, columns: list[str], most: int = 5000, rows_a_tile: int = 2000) -> DataFrame:
    """Pairs a_<key> < b_<key> with both rows' columns: equal on the block column (null never pairs), or all pairs if they are few enough.

    The pairs of a large block are spread over tasks tile by tile.
    """
    wanted = list(dict.fromkeys([key, *([block] if block else []), *columns]))
    if block:
        left, right, tasks, _ = tiled(df.select(*wanted), key, block, rows_a_tile)
        left, right = (side.repartition(tasks, block, "_i", "_j") for side in (left, right))
        x = left.select(F.col(block).alias("_block"), "_i", "_j", *(F.col(c).alias(f"x_{c}") for c in wanted))
        y = right.select(F.col(block).alias("_block"), "_i", "_j", *(F.col(c).alias(f"y_{c}") for c in wanted))
        first = F.col(f"x_{key}") < F.col(f"y_{key}")
        met = x.join(y, ["_block", "_i", "_j"]).where(first | ((F.col("_i") < F.col("_j")) & (F.col(f"x_{key}") > F.col(f"y_{key}"))))
        one = lambda c, p, q: F.when(first, F.col(f"{p}_{c}")).otherwise(F.col(f"{q}_{c}"))
        return met.select(*(one(c, "x", "y").alias(f"a_{c}") for c in wanted), *(one(c, "y", "x").alias(f"b_{c}") for c in wanted))
    a = df.select(*(F.col(c).alias(f"a_{c}") for c in wanted))
    b = df.select(*(F.col(c).alias(f"b_{c}") for c in wanted))
    n = df.count()
    if n * (n - 1) // 2 > most:
        raise ValueError(f"{n * (n - 1) // 2} pairs without a block column; at most {most}")
    return a.join(b, F.col(f"a_{key}") < F.col(f"b_{key}"))


def scored_pairs(pairs: DataFrame, key: str, matches: list[Match]) -> DataFrame:
    """a, b, score and matched_on: matched weight (times similarity where fuzzy) over all weights; nulls never match."""
    total = sum(m.weight for m in matches)
    terms, hits = [], []
    for m in matches:
        if f"a_{m.column}" not in pairs.columns:
            continue
        a, b = F.col(f"a_{m.column}"), F.col(f"b_{m.column}")
        alike = similarity(a, b, m.threshold) if m.kind == "fuzzy" else matching_ratio(a, b, m.threshold) if m.kind == "blocks" else F.when(F.coalesce(same(a, b), F.lit(False)), 1.0).otherwise(0.0)
        hit = alike >= (1.0 if m.kind == "exact" else m.threshold)
        terms.append(F.when(hit, m.weight * alike).otherwise(0.0))
        hits.append(F.when(hit, F.lit(m.column)))
    score: Column = reduce(lambda x, y: x + y, terms) / F.lit(float(total))
    return pairs.select(F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"), score.alias("score"), F.array_sort(F.array_compact(F.array(*hits))).alias("matched_on"))


def block_scores(df: DataFrame, key: str, block: str, matches: list[Match], named: bool = True, rows_a_tile: int = 2000, large: int = 5000) -> DataFrame:
    """scored_pairs() of the candidate pairs of df, all of them; without matched_on unless named.

    Where blocks have `large` pairs and more in the mean, a tile of rows is scored at once over Arrow instead of joined pair by pair.
    """
    columns = list(dict.fromkeys(m.column for m in matches))
    text = lambda m: F.col(m.column).cast("string") if m.kind == "blocks" else F.lower(F.trim(F.col(m.column).cast("string")))
    rows = df.where(F.col(key).isNotNull()).select(F.col(block).alias("_block"), F.col(key).alias("_key"), *(text(m).alias(f"_m{k}") for k, m in enumerate(matches)))
    left, right, tasks, mean = tiled(rows, "_key", "_block", rows_a_tile)
    if mean < large:
        scored = scored_pairs(candidate_pairs(df, key, block, columns, rows_a_tile=rows_a_tile), key, matches)
        return scored if named else scored.drop("matched_on")
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1))).repartition(tasks, "_block", "_i", "_j")
    held = dict(rows.dtypes)["_key"]
    score = tile_scores([(m.column, m.weight, m.kind, m.threshold) for m in matches], named)
    return both.groupBy("_block", "_i", "_j").applyInArrow(score, f"a {held}, b {held}, score double" + (", matched_on array<string>" if named else ""))


def connected(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over links (a, b), by least labels with pointer jumping."""
    ends = links.select("a", "b").where("a <> b")
    edges = written(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = edges.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    while True:
        least = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("other"))
        near = labels.join(least, labels["node"] == least["a"]).select("node", F.col("component").alias("was"), F.least("component", "other").alias("component"))
        far = labels.select(F.col("node").alias("at"), F.col("component").alias("jump"))
        now = written(near.join(far, near["component"] == far["at"]).select("node", "was", F.least("component", "jump").alias("component")))
        labels = now.select("node", "component")
        if now.where("component <> was").isEmpty():
            return labels


def clusters(scored: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(members: node, component; report: component, rows, confidence to 3 decimals, matched_on) of pairs scored at least `least`."""
    links = written(scored.where(F.col("score") >= least))
    members = connected(links)
    return members, reported(links.join(members, links["a"] == members["node"]), members)


def reported(tied: DataFrame, members: DataFrame) -> DataFrame:
    """component, rows, confidence and matched_on, of links with their component and of all members."""
    stats = tied.groupBy("component").agg(F.bround(F.max("score"), 3).alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("matched_on")))).alias("matched_on"))
    sizes = members.groupBy("component").agg(F.count("*").alias("rows"))
    return stats.join(sizes, "component").select("component", "rows", "confidence", "matched_on")


def clustered(df: DataFrame, key: str, block: str, matches: list[Match], least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """clusters() of the pairs of df within blocks, without writing out the pairs of rows that are alike.

    Rows of one block whose match columns read the same are a class: one score holds for all pairs
    in it, and one for all pairs of two classes, so only classes are paired and linked, and rows
    get the component of their class. Matching blocks can depend on which row comes first; with
    them all pairs are scored.
    """
    columns = list(dict.fromkeys(m.column for m in matches))
    if any(m.kind == "blocks" for m in matches):
        return clusters(scored_pairs(candidate_pairs(df, key, block, columns), key, matches), least)
    rows = df.where(F.col(block).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("node"), F.col(block).alias("_block"), *(F.lower(F.trim(F.col(c).cast("string"))).alias(c) for c in columns))
    classes = written(rows.groupBy("_block", *columns).agg(F.min("node").alias("_first"), F.max("node").alias("_last")).withColumn("_id", F.monotonically_increasing_id()))
    inside = classes.where("_first < _last").select(*(F.col(c).alias(f"{s}_{c}") for s in "ab" for c in ["_id", *columns]))
    across = candidate_pairs(classes, "_id", "_block", [*columns, "_first", "_last"]).where("least(a__first, b__first) < greatest(a__last, b__last)")  # a row is no pair with itself
    links = written(scored_pairs(inside, "_id", matches).unionByName(scored_pairs(across, "_id", matches)).where(F.col("score") >= least))
    tied = links.select(F.explode(F.array("a", "b")).alias("_id")).distinct()
    named = classes.join(tied, "_id").select("_id", F.col("_block").alias("_at"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(columns)))
    held = written(rows.join(named, reduce(lambda x, y: x & y, (rows[c].eqNullSafe(named[f"_{k}"]) for k, c in enumerate(columns)), rows["_block"] == named["_at"])).select("node", "_id"))
    shared = held.groupBy("node").agg(F.min("_id").alias("a"), F.max("_id").alias("_most")).where("a < _most")  # keys that several classes hold
    same_row = shared.join(held, "node").select("a", F.col("_id").alias("b"))
    found = connected(links.select("a", "b").unionByName(same_row)).withColumnRenamed("node", "_id")
    labels = tied.join(found, "_id", "left").select("_id", F.coalesce("component", "_id").alias("_label"))
    least_key = labels.join(classes, "_id").groupBy("_label").agg(F.min("_first").alias("component"))
    components = written(labels.join(least_key, "_label").select("_id", "component"))
    members = written(held.join(components, "_id").select("node", "component").distinct())
    return members, reported(links.join(components, links["a"] == components["_id"]), members)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with consecutive numbers from 1 in the given order: ranges are sorted apart, and each begins after the rows before it."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")))
    before = rows.groupBy("_part").agg(F.count("*").alias("_n")).selectExpr("_part", "coalesce(sum(_n) over (order by _part rows between unbounded preceding and 1 preceding), 0) as _before")  # one row per partition
    return rows.join(before, "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def dedup_report(members: DataFrame, report: DataFrame) -> DataFrame:
    """cluster_id (DUP-001 by falling confidence), rows, confidence in %, matched_on as text, row_indices."""
    ids = members.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("row_indices"))
    ranked = numbered(report, [F.desc("confidence"), F.asc("component")], "k")
    return ranked.join(ids, "component").select(F.format_string("DUP-%03d", "k").alias("cluster_id"), "rows", F.bround(F.col("confidence") * 100, 1).alias("confidence"), F.array_join("matched_on", ", ").alias("matched_on"), "row_indices")


def golden_records(df: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """Per component the most complete row (ties: the least key), its gaps filled by the first non-null by key."""
    columns = [c for c in df.columns if c != key]
    full = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    rows = df.join(members, df[key] == members["node"]).withColumn("_full", full)
    rank = F.struct(-F.col("_full"), F.col(key))
    picks = [F.coalesce(F.min_by(c, rank), F.min_by(c, F.when(F.col(c).isNotNull(), F.col(key)))).alias(c) for c in columns]
    return rows.groupBy("component").agg(F.min_by(key, rank).alias(key), *picks)
