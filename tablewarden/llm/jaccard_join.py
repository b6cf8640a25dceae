"""Exact near-duplicate components under the Jaccard distance of word shingles, by Voronoi cells and triangle windows.

1. Root regions. Two sets of similarity t or more share a shingle among the first
   n - ceil(t * n) + 1 of each in any common order. Ordered from rare to frequent, a
   document's first shingles name the few regions in which all its partners are found;
   documents whose first shingles are theirs alone are settled at once.
2. Cells. In every region pivots are drawn and the region's sets measured exactly against
   them. A set within r = 1 - t of a pivot joins the Voronoi cell of its nearest one and is
   linked to it. Sets within 2 r of a pivot, but not r, are boundary sets: the triangle
   inequality allows them partners in the pivot's cell, so they are replicated to it. Farther
   sets have none there. What is in no cell is the region again, with eight times as many
   pivots, until nobody is left.
3. Boundaries. After one run of connected components only boundary sets of another component
   than the cell's matter. Each cell with such sets is a region of its own: pivots are drawn
   from its boundary sets and measured against those members of the cell whose distance to
   the cell's centre lies within r of theirs, again with ever more pivots, until the
   components meet or every boundary set has been a pivot.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, binary, dropped, mix, small_broadcasts, parts_of, shingles, slices, small_batches, stored, tasks, utf8
from .components import components, merged

#: The share of the hash space whose shingles every document emits, so that their frequency is known; more than 1 - t.
KNOWN = 0.36
#: Pivots of a region grow by this factor from turn to turn.
GROWTH = 8
#: Up to so many sets to be measured are picked by a broadcast of their names (some 2 MB in the driver), so that the others are not shuffled; more are picked by a join.
FEW = 1 << 14
SLICE = 1 << 19


def sets_of(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each row."""
    h, off = shingles(data, offsets, size)
    for a, z in zip(off[:-1], off[1:]):
        x = np.sort(h[a:z])
        yield x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def set_key(x: np.ndarray) -> np.uint64:
    """A 64-bit name of a set."""
    return mix(np.add.reduce(mix(x ^ U64(0x5851F42D4C957F2D)), dtype=np.uint64) + np.uint64([len(x)]))[0] if len(x) else U64(0)


PAYLOAD = [("bucket", pa.int32()), ("token", pa.binary()), ("owner", pa.binary()), ("ids", pa.list_(pa.int64())), ("heads", pa.binary())]


def _payload(token: np.ndarray, owner: np.ndarray, buckets: int, turn: int = 0, ids: list | None = None, heads: np.ndarray | None = None) -> pa.RecordBatch:
    """One row per bucket with its tokens and their owners; ids and heads go with one of them."""
    place = (mix(token) >> U64(32)) * U64(buckets) >> U64(32)
    order = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[order], np.arange(buckets + 1, dtype=np.uint64))
    used = [k for k in range(buckets) if cuts[k] < cuts[k + 1] or ids and k == turn % buckets]
    at = [order[cuts[k] : cuts[k + 1]] for k in used]
    mine = [bool(ids) and k == turn % buckets for k in used]
    cols = [used, [binary(token[x]) for x in at], [binary(owner[x]) for x in at], [ids if m else [] for m in mine], [binary(heads) if m else b"" for m in mine]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, PAYLOAD)], [c for c, _ in PAYLOAD])


def _met(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token, owner and the token's number of owners, once for each pair of them in a bucket's rows."""
    token, owner = (np.frombuffer(b"".join(rows[c]), np.uint64) for c in ("token", "owner"))
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner = token[new], owner[new]
    cut = np.flatnonzero(np.diff(token, prepend=~token[:1]) != 0)
    many = np.diff(np.append(cut, len(token)))
    return token, owner, np.repeat(many, many)


def _bucketed(dealt: DataFrame, buckets: int):
    """Four buckets to a partition, so that partitions get about as much each."""
    return dealt.repartition(max(1, buckets // 4), "bucket").groupBy("bucket")


def tally(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, cls, n, known): every row's set, its size and how many of its shingles lie in the known range; (cls, shared): how many of these another class has too."""
    buckets, limit = 4 * parts_of(docs), U64(int(KNOWN * 2**64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, b in enumerate(small_batches(batches)):
            data, offsets = utf8(b.column("text"))
            heads, tokens, owners = [], [], []
            for i, j in slices(offsets, SLICE):
                for x in sets_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size):
                    key, known = set_key(x), int(np.searchsorted(x, limit))
                    heads.append((key, len(x), known))
                    tokens.append(x[:known])
                    owners.append(np.full(known, key))
            token, owner = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (tokens, owners))
            yield _payload(token, owner, buckets, turn, b.column("doc_id").to_pylist(), np.array(heads, np.uint64))

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        _, owner, many = _met(rows)
        cls, shared = np.unique(owner[many > 1], return_counts=True)
        heads = np.frombuffer(b"".join(rows["heads"]), np.uint64).reshape(-1, 3)
        ids = pd.array([x for ids in rows["ids"] for x in ids], "Int64")
        first = pd.DataFrame({"doc_id": pd.array([pd.NA] * len(cls), "Int64"), "cls": cls.view(np.int64), "n": 0, "known": 0, "shared": shared})
        return pd.concat([first, pd.DataFrame({"doc_id": ids, "cls": heads[:, 0].copy().view(np.int64), "n": heads[:, 1].astype(np.int64), "known": heads[:, 2].astype(np.int64), "shared": -1})])

    dealt = docs.mapInArrow(deal, "bucket int, token binary, owner binary, ids array<long>, heads binary")
    rows = stored(_bucketed(dealt, buckets).applyInPandas(count, "doc_id long, cls long, n long, known long, shared long"))
    return rows.where("shared < 0").drop("shared"), rows.where("shared > 0").groupBy("cls").agg(F.sum("shared").alias("shared"))


def first_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(token, cls, n, most, centre) regions: each set's shared shingles among its first, from rare to frequent; sets left alone in a region are out of it.

    Shingles of nobody else come first, so that a set with many of them has few others among
    its first, or none. most is how many it shares at all, a bound of what it can have in
    common. centre is the mean logarithm of its shingles' frequencies: an original has no
    shingles of its own, its changed copies have, so it stands highest there and as a pivot
    gathers copies that are far from each other.
    """
    total = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    buckets = 4 * max(tasks(sets.sparkSession), -(-total // (1 << 20)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, cls = b.column("shingles"), b.column("cls").to_numpy().view(np.uint64)
            off = column.offsets.to_numpy()
            for i, j in slices(off.astype(np.int64), 1 << 20):
                token = column.values.to_numpy()[off[i] : off[j]].view(np.uint64)
                yield _payload(token, np.repeat(cls[i:j], np.diff(off[i : j + 1])), buckets)

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        token, owner, many = _met(rows)
        shared = many > 1
        return pd.DataFrame({"cls": owner[shared].view(np.int64), "token": token[shared].view(np.int64), "df": many[shared]})

    tokens = stored(_bucketed(sets.select("cls", "shingles").mapInArrow(deal, "bucket int, token binary, owner binary, ids array<long>, heads binary"), buckets).applyInPandas(count, "cls long, token long, df long"))
    own = tokens.groupBy("cls").agg(F.count("*").alias("most"), F.sum(F.log2("df")).alias("frequency")).join(sets.select("cls", F.size("shingles").cast("long").alias("n")), "cls")
    own = own.selectExpr("cls", "n", "most", "frequency / n as centre", f"n - (({percent} * n + 99) div 100) + 1 - (n - most) as first").where("first > 0")
    kept = tokens.join(own, "cls").selectExpr("*", "row_number() over (partition by cls order by df, token) as k").where("k <= first").select("token", "cls", "n", "most", "centre")
    out = stored(linkable(kept, percent))
    dropped(tokens)
    return out


def linkable(state: DataFrame, percent: int) -> DataFrame:
    """The rows of regions with another class in them whose size and shared shingles leave a link possible."""
    sizes = state.groupBy("token", F.col("n").alias("other_n")).agg(F.max("most").alias("other_most"), F.count("*").alias("many"))
    here = sizes.withColumnRenamed("token", "region")
    possible = F.expr(f"token = region and {100 + percent} * least(most, other_most) >= {percent} * (n + other_n) and (n <> other_n or many > 1)")
    return state.join(here, possible, "left_semi")


def set_table(docs: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """(cls, shingles) of one document of each class in reps (doc_id, cls)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            data, offsets = utf8(b.column("text"))
            want = b.column("cls").to_numpy(zero_copy_only=False)
            for i, j in slices(offsets, SLICE):
                found = [(c, x) for c, x in zip(want[i:j], sets_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)) if len(x) and set_key(x).view(np.int64) == c]
                sizes = np.cumsum([0] + [len(x) for _, x in found])
                values = np.concatenate([x for _, x in found]).view(np.int64) if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values))], ["cls", "shingles"])

    rows = docs.join(reps, docs["doc_id"].eqNullSafe(reps["rep"])).select("cls", "text")
    return stored(rows.mapInArrow(run, "cls long, shingles array<long>").dropDuplicates(["cls"]))


def measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """cls, pivot, common, d and linked of the pairs (cls, n, pivot, pivot_n) that are at most 2 (1 - t) apart, written; pairs of too unlike sizes are not measured."""
    wide = max(0, 2 * percent - 100)
    near = stored(pairs.where(f"100 * least(n, pivot_n) >= {wide} * greatest(n, pivot_n)").distinct())
    ends = stored(near.select(F.explode(F.array("cls", "pivot")).alias("cls")).distinct())
    # both sides of the pairs read the same picked sets, so these are shuffled once
    sets = sets.join(F.broadcast(ends) if ends.count() <= FEW else ends.hint("merge"), "cls", "left_semi")
    a, b = sets.select("cls", F.col("shingles").alias("x")), sets.select(F.col("cls").alias("pivot"), F.col("shingles").alias("y"))
    both = near.join(b, "pivot").join(a, "cls").select("cls", "pivot", "n", "pivot_n", F.size(F.array_intersect("x", "y")).cast("long").alias("common"))
    exact = both.withColumn("union", F.expr("n + pivot_n - common")).where(f"100 * common >= {wide} * union")
    out = stored(exact.selectExpr("cls", "pivot", "common", "1 - common / union as d", f"100 * common >= {percent} * union as linked"))
    for spent in (near, ends):
        dropped(spent)
    return out


def drawn(rows: DataFrame, region: str, many: int) -> DataFrame:
    """(region, pivot, pivot_n): of each region the `many` most central classes, so that regions of the same classes draw the same pivots."""
    first = rows.selectExpr("*", f"row_number() over (partition by {region} order by centre desc, xxhash64(cls), cls) as k").where(f"k <= {many}")
    return first.select(region, F.col("cls").alias("pivot"), F.col("n").alias("pivot_n"))


def cells(regions: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """All pairs measured (cls, pivot, d, linked), and the cells (cls, pivot): of each region that a class left for a cell, its nearest pivot."""
    state, many, tables, homes, spent = regions, 1, [], [], []
    while True:
        pivots = stored(drawn(state, "token", many))
        met = stored(state.join(pivots, "token").where("cls <> pivot"))
        new = measured(met.select("cls", "n", "pivot", "pivot_n"), sets, percent)
        nearest = stored(met.join(new.where("linked"), ["cls", "pivot"]).groupBy("token", "cls").agg(F.min_by("pivot", F.struct("d", "pivot")).alias("pivot")))
        tables.append(new)
        homes.append(nearest)
        gone = nearest.select("token", "cls").unionByName(pivots.select("token", F.col("pivot").alias("cls")))
        left = stored(state.join(gone, ["token", "cls"], "left_anti"))
        state, many = stored(linkable(left, percent)), many * GROWTH
        for x in (*spent, pivots, met, left):
            dropped(x)
        spent = [state]
        if state.isEmpty():
            out = tuple(stored(reduce(DataFrame.unionByName, parts).distinct()) for parts in (tables, [x.select("cls", "pivot") for x in homes]))
            for x in (*spent, *tables, *homes):
                dropped(x)
            return out


def boundary_links(labels: DataFrame, met: DataFrame, homes: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """labels (node, label) after the links between cells and boundary sets of other components."""
    radius = 1 - percent / 100 + 1e-9
    core = homes.join(met.select("cls", "pivot", "common", "d"), ["cls", "pivot"]).join(sizes, "cls")
    edge = met.where("not linked").select(F.col("pivot").alias("cell"), "cls", "common", "d").join(sizes, "cls")
    many, spent = 1, []
    while True:
        of_cls, of_cell = labels.select(F.col("node").alias("cls"), F.col("label").alias("own")), labels.select(F.col("node").alias("cell"), F.col("label").alias("main"))
        # labels holds what has links; a class without any is its own component
        apart = edge.join(of_cls, "cls", "left").join(of_cell, "cell", "left").where("coalesce(own, cls) <> coalesce(main, cell)").drop("own", "main")
        edge = stored(apart)
        for x in spent:
            dropped(x)
        if edge.isEmpty():
            dropped(edge)
            return labels
        pivots = drawn(edge, "cell", many).join(edge.select("cell", F.col("cls").alias("pivot"), F.col("d").alias("pivot_d"), F.col("most").alias("pivot_most"), F.col("common").alias("pivot_common")), ["cell", "pivot"])
        pivots = stored(pivots)
        # what two sets share lies in the centre's set, or among the shared shingles outside it
        both = "least(common, pivot_common) + least(most - common, pivot_most - pivot_common)"
        possible = f"cls <> pivot and abs(d - pivot_d) <= {radius} and {100 + percent} * ({both}) >= {percent} * (n + pivot_n)"
        window = core.select(F.col("pivot").alias("cell"), "cls", "n", "most", "common", "d").join(pivots, "cell").where(possible)
        found = measured(window.select("cls", "n", "pivot", "pivot_n"), sets, percent)
        labels = merged(labels, found.where("linked").select(F.col("cls").alias("a"), F.col("pivot").alias("b")))
        dropped(found)
        spent = [edge, pivots]
        edge, many = edge.join(pivots.select("cell", F.col("pivot").alias("cls")), ["cell", "cls"], "left_anti"), many * GROWTH


def link_classes(regions: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, label) of all classes that have a link: the components of exact links."""
    met, homes = cells(regions, sets, percent)
    links = met.where("linked").select(F.col("cls").alias("a"), F.col("pivot").alias("b"))
    labels = components(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), links)
    sizes = stored(regions.select("cls", "n", "most", "centre").distinct())
    out = boundary_links(labels, met, homes, sizes, sets, percent)
    for spent in (met, homes, sizes):
        dropped(spent)
    return out


def _classes(core: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows' sets as tally() has them, and (cls, component) of every set that is not empty, written."""
    heads, shared = tally(core, size)
    classes = heads.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("known").alias("known"))
    # as many shingles of its own as a set has first ones: no partner
    wanted = classes.join(shared, "cls", "left").where(f"n - (({percent} * n + 99) div 100) + 1 > known - coalesce(shared, 0)").select("cls", "rep")
    sets = set_table(core, wanted, size)
    regions = first_shingles(sets, percent)
    labels = link_classes(regions, sets, percent)
    named = classes.join(labels, classes["cls"] == labels["node"], "left").select("cls", "rep", F.coalesce("label", "cls").alias("label"))
    names = named.groupBy("label").agg(F.min("rep").alias("component"))
    by_class = stored(named.join(names, "label").select("cls", "component"))
    for spent in (sets, regions, labels):
        dropped(spent)
    return heads, by_class


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs (doc_id, text).

    Links hold exactly where 100 * intersection >= percent * union of the shingle sets;
    component_id is the smallest doc_id reachable. Null, empty and blank texts have no
    shingles and stay alone. Equal sets are one class, measured once. Repeated rows are
    kept each; a null doc_id is never a component's name unless no other is there. Other
    columns are ignored. An empty table gives an empty result.
    """
    core = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with small_broadcasts(docs.sparkSession):
        heads, by_class = _classes(core, size, percent)
    return (heads.join(by_class, "cls", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")))
