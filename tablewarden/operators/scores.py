"""Scores and indicators over rule results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rules import DIMENSIONS


def by_dataset(results: DataFrame) -> DataFrame:
    return results.groupBy("dataset").agg(F.bround(F.avg("score"), 2).alias("quality"))


def by_dimension(results: DataFrame) -> DataFrame:
    return results.groupBy("dimension").agg(F.bround(F.avg("score"), 2).alias("quality"))


def matrix(results: DataFrame) -> DataFrame:
    """dataset x dimension means; a pair without rules is null."""
    return results.groupBy("dataset").pivot("dimension", DIMENSIONS).agg(F.bround(F.avg("score"), 2))


def overall(results: DataFrame) -> DataFrame:
    return results.agg(F.bround(F.avg("score"), 2).alias("quality_index"))


def with_quality(catalog: DataFrame, results: DataFrame) -> DataFrame:
    """catalog with each dataset's mean score; null without rules."""
    return catalog.join(by_dataset(results), "dataset", "left")


def distinct_counts(catalog: DataFrame, described: DataFrame) -> DataFrame:
    """One row: stewards and owners named, and business terms in use."""
    term = F.nullif(F.trim("business_term"), F.lit(""))
    people = catalog.agg(F.count_distinct(F.nullif(F.trim("steward"), F.lit(""))).alias("stewards"), F.count_distinct(F.nullif(F.trim("owner"), F.lit(""))).alias("owners"))
    return people.crossJoin(described.agg(F.count_distinct(term).alias("terms_in_use")))


def open_issues(results: DataFrame) -> DataFrame:
    """Rules that do not pass: warn is of medium severity, fail of high."""
    return results.where("status <> 'pass'").withColumn("severity", F.when(F.col("status") == "warn", "media").otherwise("alta"))


def kpis(results: DataFrame) -> DataFrame:
    """(kpi, value): rules in all and by status."""
    wide = results.agg(F.count("*").alias("rules_total"), *(F.count_if(F.col("status") == s).alias(f"rules_{s}") for s in ("pass", "warn", "fail")))
    return wide.unpivot([], wide.columns, "kpi", "value")


def run_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.bround(F.avg("score"), 2).alias("quality_index"), F.count_if(F.col("status") == "pass").alias("ok"), F.count("*").alias("total"),
                       F.count_if(F.col("status") == "fail").alias("fails"), F.count_if(F.col("status") != "pass").alias("alerts"), F.coalesce(F.sum("affected_rows"), F.lit(0)).cast("bigint").alias("affected_rows"))


def impact(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: index gain (one decimal) and reduction of affected rows in %."""
    a, b = run_summary(before).select(F.col("quality_index").alias("index_before"), F.col("affected_rows").alias("rows_before")), run_summary(after).select(F.col("quality_index").alias("index_after"), F.col("affected_rows").alias("rows_after"))
    cut = F.when(F.col("rows_before") == 0, 0.0).otherwise(F.bround(100.0 * (F.col("rows_before") - F.col("rows_after")) / F.col("rows_before"), 1))
    return a.crossJoin(b).withColumn("index_gain", F.bround(F.col("index_after") - F.col("index_before"), 1)).withColumn("reduction_pct", cut)


def impact_by_dimension(before: DataFrame, after: DataFrame) -> DataFrame:
    """(dimension, moment, quality) in long form, for dimensions in both runs."""
    both = by_dimension(before).withColumnRenamed("quality", "before").join(by_dimension(after).withColumnRenamed("quality", "after"), "dimension")
    return both.unpivot(["dimension"], ["before", "after"], "moment", "quality")


def trend(runs: DataFrame) -> DataFrame:
    """(month, quality_index) of stored results with run_ts: the last run of each month."""
    each = runs.groupBy("run_ts").agg(F.avg("score").alias("q"))
    return each.groupBy(F.date_trunc("month", "run_ts").alias("month")).agg(F.bround(F.max_by("q", "run_ts"), 2).alias("quality_index"))
