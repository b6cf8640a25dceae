"""Export shapes of governance tables: entities, terms, classification groups, label plans, glossary drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import brief, expand_abbreviations, pii_type
from .governance import with_remedy
from .profile import profile_table, summary
from .rules import auto_rules, evaluate_rules


def entities(catalog: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(qualified_name, kind, name, parent, description): tables, and columns with their parent."""
    tables = catalog.select(F.col("dataset").alias("qualified_name"), F.lit("table").alias("kind"), F.col("dataset").alias("name"), F.lit(None).cast("string").alias("parent"), brief(F.col("description"), 255).alias("description"))
    columns = dictionary.select(F.concat_ws(".", "dataset", "column").alias("qualified_name"), F.lit("column").alias("kind"), F.col("column").alias("name"), F.col("dataset").alias("parent"), brief(F.col("description"), 255).alias("description"))
    return tables.unionByName(columns)


def exported_terms(glossary: DataFrame, curation: DataFrame) -> DataFrame:
    """Terms as Approved where their curation is done, else Draft."""
    own = curation.select(F.col("item_id").alias("term_id"), F.col("status").alias("_status"))
    return glossary.join(own, "term_id", "left").select("term_id", "term", "definition", F.when(F.col("_status").isin("validado", "modificado"), "Approved").otherwise("Draft").alias("status"))


def classification_groups(dictionary: DataFrame) -> DataFrame:
    """(classification, columns): PII columns by kind."""
    pii = dictionary.where("pii").select(pii_type(F.col("column")).alias("classification"), F.concat_ws(".", "dataset", "column").alias("q"))
    return pii.groupBy("classification").agg(F.array_join(F.array_sort(F.collect_set("q")), "; ").alias("columns"))


def with_external_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows that have an external id (ids: qualified_name, guid)."""
    return rows.join(ids, "qualified_name").select(*rows.columns, "guid")


def label_plan(catalog: DataFrame, files: DataFrame, labels: DataFrame) -> DataFrame:
    """(dataset, path, label, state): the first label by priority whose hint is in the classification (labels: label, hint, priority); datasets without a file are skipped."""
    hit = catalog.join(labels, F.contains(F.lower("classification"), F.lower("hint"))).groupBy("dataset").agg(F.min_by("label", "priority").alias("label"))
    joined = catalog.join(files, "dataset", "left").join(hit, "dataset", "left")
    return joined.select("dataset", "path", "label", F.when(F.col("path").isNull(), "skipped").when(F.col("label").isNull(), "no label").otherwise("planned").alias("state"))


def glossary_drafts(columns: DataFrame, abbreviations: dict[str, str]) -> DataFrame:
    """A draft term per column (conn_id, table, column), with a stable id and whether anything was written out."""
    text, changed = expand_abbreviations(F.col("column"), abbreviations)
    prefix = F.when(F.coalesce("conn_id", F.lit("")) != "", F.concat("conn_id", F.lit(":"))).otherwise("")
    return columns.select(F.concat(prefix, "table", F.lit("."), "column").alias("term_id"), text.alias("term"), changed.alias("expanded"), F.col("table"))


def file_report(spark: SparkSession, df: DataFrame, name: str, remedies: DataFrame, order: str | None = None) -> dict[str, DataFrame]:
    """summary (field, value), profile, quality and fixes of one table: its profile, the rules proposed from it, and an action for each rule that does not pass."""
    profile, shape = profile_table(df, order), summary(df)
    rows = profile.collect()  # one row per column
    total = shape.first()
    results = evaluate_rules(spark, auto_rules(rows, total["rows"], True, name), {name: df})
    graded = results.agg(F.bround(F.avg("score"), 2).alias("index"), F.count_if(F.col("status") == "pass").alias("ok"), F.count("*").alias("all"))
    pii = ", ".join(r["column"] for r in rows if r["possible_pii"]) or "—"
    text = lambda c: F.col(c).cast("string")
    wide = shape.crossJoin(graded).select(F.lit(name).alias("dataset"), text("rows"), text("columns"), text("duplicate_rows"), F.concat(text("null_cell_pct"), F.lit("%")).alias("null_cells"),
                                          F.coalesce(F.concat(text("index"), F.lit(" / 100")), F.lit("—")).alias("quality"), F.concat(text("ok"), F.lit(" / "), text("all")).alias("rules_passed"), F.lit(pii).alias("pii_columns"))
    fixes = with_remedy(results.where("status <> 'pass'"), remedies).select("rule_id", "column", "description", "action")
    return {"summary": wide.unpivot([], wide.columns, "field", "value"), "profile": profile, "quality": results, "fixes": fixes}
