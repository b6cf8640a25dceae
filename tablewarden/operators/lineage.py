"""Lineage graphs as two tables: nodes (id, label, layer) and edges (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def closure(edges: DataFrame, starts: DataFrame | None = None, down: bool = True, growth: int = 4) -> DataFrame:
    """(start, node, depth): everything reachable from every start (default: every node), nearest depth first met, start left out; cycles end.

    Walks double: what is known up to depth d is joined to the jumps of exactly d edges, and the
    jumps to themselves, so the rounds grow with the logarithm of the longest distance. Where
    jumps outgrow the edges (growth times as many), the graph is bushy and its distances short;
    from there on only the last nodes met are joined to the edges, round after round.
    """
    src, dst = ("src", "dst") if down else ("dst", "src")
    step = written(edges.select(F.col(src).alias("at"), F.col(dst).alias("next")).where("at is not null and next is not null").distinct())
    starts = starts if starts is not None else edges.select(F.explode(F.array("src", "dst")).alias("start")).distinct()
    seen = written(starts.where("start is not null").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("depth")))
    edge_count = step.count()
    one_way = any(step.groupBy(end).agg(F.count("*").alias("n")).where("n > 1").isEmpty() for end in ("at", "next"))  # then jumps of one length are no more than edges, and none comes twice
    jumps, length, known, most, many = step, 1, seen.count(), growth * edge_count + 1000, edge_count
    while jumps is not None:
        if not many:
            return seen.where("depth > 0")
        reached = seen.join(jumps, seen["node"] == jumps["at"]).select("start", F.col("next").alias("node"), (F.col("depth") + length).alias("depth"))
        seen = written(seen.unionByName(reached).groupBy("start", "node").agg(F.min("depth").alias("depth")))
        before, known, length = known, seen.count(), length * 2
        if known == before:
            return seen.where("depth > 0")
        through = 0
        if one_way:
            through = many
        elif many > 1000:  # fewer make a million at most
            through = jumps.groupBy(F.col("next").alias("at")).agg(F.count("*").alias("i")).join(jumps.groupBy("at").agg(F.count("*").alias("o")), "at").agg(F.sum(F.col("i") * F.col("o")).alias("n")).first()["n"] or 0
        further = jumps.select(F.col("at").alias("from"), F.col("next").alias("at")).join(jumps, "at").select(F.col("from").alias("at"), "next")
        jumps = written(further if one_way else further.distinct()) if through <= most else None
        many = jumps.count() if jumps is not None else 0
    depth, frontier = length - 1, seen.where(F.col("depth") == length - 1).select("start", "node")
    while True:
        depth += 1
        near = frontier.join(step, frontier["node"] == step["at"]).select("start", F.col("next").alias("node")).distinct()
        frontier = written(near.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        if frontier.isEmpty():
            return seen.where("depth > 0")
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(depth)))


def one(edges: DataFrame, node: str, down: bool) -> DataFrame:
    start = edges.sparkSession.createDataFrame([(node,)], "start string")
    return closure(edges, start, down).select("node", "depth")


def upstream(edges: DataFrame, node: str) -> DataFrame:
    return one(edges, node, False)


def downstream(edges: DataFrame, node: str) -> DataFrame:
    return one(edges, node, True)


def consumers(nodes: DataFrame, edges: DataFrame, layer: str = "dataset") -> DataFrame:
    """(start, consumers): labels of all that each node of the layer feeds, by depth and label."""
    reached = closure(edges, nodes.where(F.col("layer") == layer).select(F.col("id").alias("start")))
    named = reached.join(nodes, reached["node"] == nodes["id"])
    return named.groupBy("start").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "label"))), lambda x: x["label"]).alias("consumers"))


def focus(edges: DataFrame, node: str) -> DataFrame:
    """Edges with both ends among the node, its ancestors and its descendants."""
    own = edges.sparkSession.createDataFrame([(node,)], "node string")
    inside = written(own.unionByName(upstream(edges, node).select("node")).unionByName(downstream(edges, node).select("node")).distinct())
    return edges.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends' labels and layers."""
    a = nodes.select(F.col("id").alias("src"), F.col("label").alias("source"), F.col("layer").alias("source_layer"))
    b = nodes.select(F.col("id").alias("dst"), F.col("label").alias("target"), F.col("layer").alias("target_layer"))
    return edges.join(a, "src").join(b, "dst").select("source", "source_layer", "target", "target_layer")


def from_flat(flat: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a flat table source, source_layer, target, target_layer; a node's layer is that of its first row by the order column (its source before its target), without one the least by name."""
    place = F.col(order) if order else F.lit(0)
    ends = flat.select(F.explode(F.array(*(F.struct(F.col(end).alias("id"), F.col(f"{end}_layer").alias("layer"), place.alias("place"), F.lit(k if order else 0).alias("k")) for k, end in enumerate(("source", "target"))))).alias("x")).select("x.*")
    nodes = ends.groupBy("id").agg(F.min_by("layer", F.struct("place", "k", "layer")).alias("layer")).select("id", F.col("id").alias("label"), "layer")
    return nodes, flat.select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()


def extended(edges: DataFrame, cases: DataFrame) -> DataFrame:
    """Edges and, for each case (source, dataset, report), source -> dataset -> report."""
    more = cases.select(F.col("source").alias("src"), F.col("dataset").alias("dst")).unionByName(cases.select(F.col("dataset").alias("src"), F.col("report").alias("dst")))
    return edges.unionByName(more).distinct()
