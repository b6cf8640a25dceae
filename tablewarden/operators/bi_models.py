"""BI metadata (nested JSON or XML) flattened into governance tables, and health rules per model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import formula_key, pii_name, source_label
from .rules import RESULT_COLUMNS

#: Fixed schemas of the two services' metadata.
TENANT = """workspaces array<struct<name:string,
  datasets:array<struct<id:string,name:string,
    tables:array<struct<name:string,columns:array<struct<name:string,dataType:string,description:string,expression:string>>,
      measures:array<struct<name:string,expression:string,description:string>>,source:array<struct<expression:string>>>>,
    relationships:array<struct<fromTable:string,fromColumn:string,toTable:string,toColumn:string,crossFilteringBehavior:string>>,
    roles:array<struct<name:string>>>>,
  reports:array<struct<name:string,datasetId:string>>>>"""
SITE = """data struct<workbooks:array<struct<name:string,projectName:string,
  upstreamDatasources:array<struct<name:string,
    fields:array<struct<name:string,description:string,formula:string>>,
    upstreamTables:array<struct<name:string,schema:string,database:struct<name:string,connectionType:string>>>>>>>>"""


def read_tenant(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TENANT).option("multiLine", True).json(path)


def read_site(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SITE).option("multiLine", True).json(path)


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """(datasource, field, datatype, description, formula, connection) of a workbook's XML; the datasource Parameters is left out."""
    schema = "_caption string, _name string, column array<struct<_caption:string,_name:string,_datatype:string,_comment:string,calculation:struct<_formula:string>>>, connection struct<_class:string,_server:string,_dbname:string>"
    raw = spark.read.format("xml").option("rowTag", "datasource").schema(schema).load(path).where("coalesce(_name, '') <> 'Parameters'")
    rows = raw.select(F.coalesce("_caption", "_name").alias("datasource"), F.col("connection._class").alias("connection"), F.explode_outer("column").alias("c"))
    return rows.select("datasource", F.coalesce("c._caption", F.regexp_replace("c._name", r"[\[\]]", "")).alias("field"), F.col("c._datatype").alias("datatype"), F.col("c._comment").alias("description"), F.col("c.calculation._formula").alias("formula"), "connection")


def tenant_tables(scan: DataFrame) -> dict[str, DataFrame]:
    """datasets, columns, measures, relationships, roles, reports and sources of a tenant scan."""
    w = scan.select(F.explode("workspaces").alias("w"))
    d = w.select(F.col("w.name").alias("workspace"), F.size("w.datasets").alias("siblings"), F.explode("w.datasets").alias("d"))
    datasets = d.select("workspace", F.col("d.id").alias("dataset_id"), F.col("d.name").alias("model"))
    t = d.select(F.col("d.id").alias("dataset_id"), F.col("d.name").alias("model"), F.explode("d.tables").alias("t"))
    base = [F.col("dataset_id"), F.col("model"), F.col("t.name").alias("table")]
    columns = t.select(*base, F.explode("t.columns").alias("c")).select("dataset_id", "model", "table", F.col("c.name").alias("column"), F.col("c.dataType").alias("type"), F.col("c.description").alias("description"), F.col("c.expression").alias("expression"))
    measures = t.select(*base, F.explode("t.measures").alias("m")).select("dataset_id", "model", "table", F.col("m.name").alias("measure"), F.col("m.expression").alias("expression"), F.col("m.description").alias("description"))
    sources = t.select(*base, F.explode("t.source").alias("s")).select("dataset_id", "model", "table", source_label(F.col("s.expression")).alias("source")).where("source is not null").distinct()
    roles = d.select(F.col("d.id").alias("dataset_id"), F.explode("d.roles").alias("r")).select("dataset_id", F.col("r.name").alias("role"))
    relationships = d.select(F.col("d.id").alias("dataset_id"), F.explode("d.relationships").alias("r")).select("dataset_id", "r.*")
    reports = w.select(F.col("w.name").alias("workspace"), F.explode("w.reports").alias("r")).select("workspace", F.col("r.name").alias("report"), F.col("r.datasetId").alias("of"))
    only = datasets.groupBy("workspace").agg(F.count("*").alias("k"), F.first("dataset_id").alias("only")).where("k = 1").select("workspace", "only")
    known = datasets.select(F.col("dataset_id").alias("found"))
    reports = reports.join(known, reports["of"] == known["found"], "left").join(only, "workspace", "left").select("workspace", "report", F.coalesce("found", "only").alias("dataset_id")).where("dataset_id is not null")
    return {"datasets": datasets, "tables": t.select(*base), "columns": columns, "measures": measures, "relationships": relationships, "roles": roles, "reports": reports, "sources": sources}


def site_tables(site: DataFrame) -> dict[str, DataFrame]:
    """workbooks, datasources (once by name), fields, links of workbooks to datasources, and sources of sites (column site; Tableau where there is none)."""
    named = site if "site" in site.columns else site.withColumn("site", F.lit("Tableau"))
    w = named.select("site", F.explode("data.workbooks").alias("w")).select("site", F.col("w.name").alias("workbook"), F.col("w.upstreamDatasources").alias("ds"))
    each = w.select("site", "workbook", F.explode("ds").alias("d"))
    once = each.groupBy("site", F.col("d.name").alias("model")).agg(F.min_by("d", "workbook").alias("d"))
    fields = once.select("site", "model", F.explode("d.fields").alias("f")).select("site", "model", F.col("f.name").alias("field"), F.coalesce("f.description", F.lit("")).alias("description"), F.coalesce("f.formula", F.lit("")).alias("formula"))
    table = F.concat_ws(".", F.nullif(F.col("t.schema"), F.lit("")), F.nullif(F.col("t.name"), F.lit("")))
    kind = F.col("t.database.connectionType")
    sources = once.select("site", "model", F.explode("d.upstreamTables").alias("t")).select("site", "model", F.when(F.coalesce(kind, F.lit("")) != "", F.concat(table, F.lit(" ("), kind, F.lit(")"))).otherwise(table).alias("source"))
    return {"workbooks": w.select("site", "workbook"), "datasources": once.select("site", "model"), "fields": fields, "links": each.select("site", F.col("d.name").alias("model"), "workbook").distinct(), "sources": sources.distinct()}


def site_catalog(t: dict[str, DataFrame]) -> DataFrame:
    """(dataset, site, classification, tables, columns) per datasource."""
    f = t["fields"].groupBy("site", "model").agg(F.count("*").alias("columns"), F.max(pii_name(F.col("field"))).alias("pii"))
    s = t["sources"].groupBy("site", "model").agg(F.count("*").alias("tables"))
    joined = t["datasources"].join(f, ["site", "model"], "left").join(s, ["site", "model"], "left")
    zero = F.lit(0)
    return joined.select(F.col("model").alias("dataset"), "site", F.when(F.coalesce("pii", F.lit(False)), "PII").otherwise("internal").alias("classification"), F.coalesce("tables", zero).alias("tables"), F.coalesce("columns", zero).alias("columns"))


def site_dictionary(t: dict[str, DataFrame]) -> DataFrame:
    """(dataset, column, type, pii, description) per field; a calculated field is described by its formula."""
    calculated = F.col("formula") != ""
    return t["fields"].select(F.concat_ws(".", "site", "model").alias("dataset"), F.col("field").alias("column"), F.when(calculated, "calculated").otherwise("").alias("type"), pii_name(F.col("field")).alias("pii"), F.when(calculated, F.concat(F.lit("formula: "), "formula")).otherwise(F.col("description")).alias("description"))


def site_terms(t: dict[str, DataFrame]) -> DataFrame:
    """Glossary rows T001... of each site: its calculated fields, defined by their description or else their formula."""
    rows = t["fields"].where("formula <> ''").select("site", "model", "field", F.coalesce(F.nullif(F.trim("description"), F.lit("")), F.col("formula")).alias("text"))
    k = rows.selectExpr("*", "row_number() over (partition by site order by model, field) as k")
    return k.select(F.format_string("T%03d", "k").alias("term_id"), F.concat_ws(".", "site", "model").alias("dataset"), F.col("field").alias("term"), F.col("text").alias("definition"))


def tenant_catalog(t: dict[str, DataFrame]) -> DataFrame:
    """(dataset, classification, tables, columns, measures) per model."""
    c = t["columns"].groupBy("dataset_id").agg(F.count_distinct("table").alias("tables"), F.count("*").alias("columns"), F.max(pii_name(F.col("column"))).alias("pii"))
    m = t["measures"].groupBy("dataset_id").agg(F.count("*").alias("measures"))
    zero = F.lit(0)
    return t["datasets"].join(c, "dataset_id", "left").join(m, "dataset_id", "left").select(F.col("model").alias("dataset"), F.when(F.coalesce("pii", F.lit(False)), "PII").otherwise("internal").alias("classification"), *(F.coalesce(x, zero).alias(x) for x in ("tables", "columns", "measures")))


def tenant_dictionary(t: dict[str, DataFrame]) -> DataFrame:
    return t["columns"].select(F.col("model").alias("dataset"), F.concat_ws(".", "table", "column").alias("column"), "type", pii_name(F.col("column")).alias("pii"), "description")


def numbered_terms(rows: DataFrame, prefix: str, model: str, name: str, text: str) -> DataFrame:
    """Glossary rows M001... (or T001...) in each model by name."""
    return rows.selectExpr("*", f"row_number() over (partition by {model} order by {name}) as k").select(F.concat(F.lit(prefix), F.format_string("%03d", "k")).alias("term_id"), F.col(model).alias("dataset"), F.col(name).alias("term"), F.col(text).alias("definition"))


def tenant_lineage(t: dict[str, DataFrame]) -> DataFrame:
    """source -> table -> model -> report; a model without reports leads to a placeholder."""
    edge = lambda df, a, la, b, lb: df.select(F.col(a).alias("source"), F.lit(la).alias("source_layer"), b.alias("target"), F.lit(lb).alias("target_layer"))
    named = t["datasets"].join(t["reports"].select("dataset_id", "report"), "dataset_id", "left")
    parts = [edge(t["sources"], "source", "source", F.col("table"), "table"), edge(t["tables"], "table", "table", F.col("model"), "model"), edge(named, "model", "model", F.coalesce("report", F.lit("(no report)")), "report")]
    return reduce(DataFrame.unionByName, parts).distinct()


def site_lineage(t: dict[str, DataFrame]) -> DataFrame:
    a = t["sources"].select("source", F.lit("source").alias("source_layer"), F.col("model").alias("target"), F.lit("model").alias("target_layer"))
    b = t["links"].select(F.col("model").alias("source"), F.lit("model").alias("source_layer"), F.col("workbook").alias("target"), F.lit("report").alias("target_layer"))
    return a.unionByName(b).distinct()


def sources_text(t: dict[str, DataFrame]) -> DataFrame:
    """(model, sources) joined by semicolons."""
    return t["sources"].groupBy("model").agg(F.array_join(F.array_sort(F.collect_set("source")), "; ").alias("sources"))


#: Fixed by the contract: rule, dimension and threshold of each health rule; the warning band is 15.
TENANT_RULES = [("PBI-01", "completeness", 80.0), ("PBI-02", "uniqueness", 90.0), ("PBI-03", "validity", 50.0), ("PBI-04", "consistency", 60.0), ("PBI-05", "validity", 85.0)]
SITE_RULES = [("TAB-01", "completeness", 80.0), ("TAB-02", "uniqueness", 90.0), ("TAB-03", "consistency", 80.0), ("TAB-04", "validity", 70.0)]


def _repeated(rows: DataFrame, by: str, formula: str) -> DataFrame:
    """(by, repeated): formulas beyond the first of each, blanks and case aside."""
    key = formula_key(F.coalesce(F.col(formula), F.lit("")))
    return rows.groupBy(by, key.alias("_f")).agg(F.count("*").alias("_k")).groupBy(by).agg(F.sum(F.col("_k") - 1).alias("repeated"))


def _health(wide: DataFrame, name: str, parts: dict[str, tuple[Column, Column, Column]], rules: list[tuple[str, str, float]]) -> DataFrame:
    """One row per model and rule from (good, out of, affected); the score has one decimal and out of nothing counts as out of one."""
    zero = F.lit(0).cast("bigint")
    each = F.array(*(F.struct(F.lit(i).alias("rule_id"), F.lit(d).alias("dimension"), F.lit(t).alias("threshold"), F.coalesce(parts[i][0], zero).alias("good"), F.greatest(F.coalesce(parts[i][1], zero), F.lit(1)).alias("n"), F.coalesce(parts[i][2], zero).cast("bigint").alias("affected_rows")) for i, d, t in rules))
    flat = wide.select(F.col(name).alias("dataset"), F.explode(each).alias("x")).select("dataset", "x.*").withColumn("score", F.bround(100.0 * F.col("good") / F.col("n"), 1))
    status = F.when(F.col("score") >= F.col("threshold"), "pass").when(F.col("score") >= F.col("threshold") - 15, "warn").otherwise("fail")
    return flat.withColumns({"column": F.lit("—"), "description": F.col("rule_id"), "status": status}).select(*RESULT_COLUMNS)


def tenant_health(t: dict[str, DataFrame]) -> DataFrame:
    """PBI-01..05 per model: documented measures, repeated formulas, row security, columns that no formula names (all, without formulas), calculated columns.

    Of no measures none is documented, of no columns none is in order: the score is 0.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    measures = t["measures"].groupBy("dataset_id").agg(F.count("*").alias("measures"), F.count_if(~blank("description")).alias("documented"), F.lower(F.concat_ws(" ", F.collect_list("expression"))).alias("formulas"))
    roles = t["roles"].groupBy("dataset_id").agg(F.count("*").alias("roles"))
    named = t["columns"].join(measures.select("dataset_id", "formulas"), "dataset_id", "left")
    columns = named.groupBy("dataset_id").agg(F.count("*").alias("columns"), F.count_if(~F.contains(F.coalesce("formulas", F.lit("")), F.lower("column"))).alias("orphans"), F.count_if(~blank("expression")).alias("calculated"))
    wide = t["datasets"].select("dataset_id", "model")
    for part in (measures.drop("formulas"), _repeated(t["measures"], "dataset_id", "expression"), roles, columns):
        wide = wide.join(part, "dataset_id", "left")
    c, n = lambda x: F.coalesce(F.col(x), F.lit(0).cast("bigint")), F.greatest(F.coalesce(F.col("measures"), F.lit(0).cast("bigint")), F.lit(1).cast("bigint"))
    secured = (c("roles") > 0).cast("bigint")
    return _health(wide, "model", {
        "PBI-01": (c("documented"), n, n - c("documented")), "PBI-02": (n - c("repeated"), n, c("repeated")), "PBI-03": (secured, F.lit(1), 1 - secured),
        "PBI-04": (c("columns") - c("orphans"), c("columns"), c("orphans")), "PBI-05": (c("columns") - c("calculated"), c("columns"), c("calculated"))}, TENANT_RULES)


def site_health(t: dict[str, DataFrame]) -> DataFrame:
    """TAB-01..04 per site: documented and not repeated calculated fields, datasources traced to tables, workbooks on a published datasource."""
    calculated = t["fields"].where("formula <> ''")
    fields = calculated.groupBy("site").agg(F.count("*").alias("fields"), F.count_if(F.trim("description") != "").alias("documented"))
    traced = t["datasources"].join(t["sources"].select("site", "model").distinct().withColumn("known", F.lit(1)), ["site", "model"], "left").groupBy("site").agg(F.count("*").alias("datasources"), F.count("known").alias("traced"))
    linked = t["links"].groupBy("site").agg(F.count_distinct("workbook").alias("linked"))
    wide = t["workbooks"].groupBy("site").agg(F.count("*").alias("workbooks"))
    for part in (fields, _repeated(calculated, "site", "formula"), traced, linked):
        wide = wide.join(part, "site", "left")
    c = lambda x: F.coalesce(F.col(x), F.lit(0).cast("bigint"))
    least = lambda x: F.greatest(c(x), F.lit(1).cast("bigint"))
    embedded = F.greatest(c("workbooks") - c("linked"), F.lit(0).cast("bigint"))
    return _health(wide, "site", {
        "TAB-01": (c("documented"), least("fields"), least("fields") - c("documented")), "TAB-02": (least("fields") - c("repeated"), least("fields"), c("repeated")),
        "TAB-03": (c("traced"), least("datasources"), least("datasources") - c("traced")), "TAB-04": (least("workbooks") - embedded, least("workbooks"), embedded)}, SITE_RULES)


def tenant_governance(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The governance tables of a tenant scan; without models each has its columns and no rows."""
    return {"catalog": tenant_catalog(t), "dictionary": tenant_dictionary(t), "glossary": numbered_terms(t["measures"], "M", "model", "measure", "expression"), "lineage": tenant_lineage(t), "quality": tenant_health(t)}


def site_governance(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The governance tables of sites; without workbooks each has its columns and no rows."""
    return {"catalog": site_catalog(t), "dictionary": site_dictionary(t), "glossary": site_terms(t), "lineage": site_lineage(t), "quality": site_health(t)}
