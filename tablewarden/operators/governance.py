"""Governance tables: catalog, curation, coverage, policies, contracts, alerts, ownership."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import folded, localized, named_person, seniority
from . import lineage, scores
from .containment import contained

PENDING, VALID, CHANGED = "sugerido_ia", "validado", "modificado"


def catalog(metadata: DataFrame, tables: dict[str, DataFrame], lang: str = "en") -> DataFrame:
    """metadata (dataset, domain and description as maps by language, owner, steward, classification) with live row and column counts."""
    counts = reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("rows")).select(F.lit(k).alias("dataset"), "rows", F.lit(len(df.columns)).cast("bigint").alias("columns")) for k, df in tables.items()))
    return metadata.withColumns({c: localized(F.col(c), lang) for c in ("domain", "description")}).join(counts, "dataset", "left")


def dictionary(tables: dict[str, DataFrame]) -> DataFrame:
    """(dataset, column, type) of all tables."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(k, c, t) for k, df in tables.items() for c, t in df.dtypes], "dataset string, column string, type string")


def glossary(terms: DataFrame, lang: str = "en") -> DataFrame:
    return terms.select("term_id", localized(F.col("term"), lang).alias("term"), localized(F.col("definition"), lang).alias("definition"), "owner", F.array_join("linked_datasets", ", ").alias("linked_datasets"))


def merged(current: DataFrame, changes: DataFrame, keys: list[str], stamp: str, sources: list[str] | None = None) -> DataFrame:
    """Latest row per key of both tables; in a tie the change wins. Rows with an empty key are left out; with sources, changes of another source (column source) are."""
    if sources is not None:
        changes = changes.where(F.col("source").isin(*sources))
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    usable = reduce(lambda a, k: a & F.coalesce(F.trim(F.col(k).cast("string")) != "", F.lit(False)), keys, F.lit(True))
    rank = f"row_number() over (partition by {', '.join(keys)} order by {stamp} desc, _new desc) as _k"
    return both.where(usable).selectExpr("*", rank).where("_k = 1").drop("_k", "_new")


def removed(current: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(gone.select(*keys), keys, "left_anti")


def curation(items: DataFrame, verdicts: DataFrame, lang: str) -> DataFrame:
    """items (item_id, dataset, text) with status and the text that holds: an override only when modified and not empty."""
    own = verdicts.where(F.col("lang") == lang).select("item_id", "status", F.col("text").alias("override"), "responsible")
    status = F.coalesce("status", F.lit(PENDING))
    effective = F.when((status == CHANGED) & (F.trim(F.coalesce("override", F.lit(""))) != ""), F.col("override")).otherwise(F.col("text"))
    return items.join(own, "item_id", "left").select("item_id", "dataset", status.alias("status"), effective.alias("text"), "responsible")


def accepted_verdicts(verdicts: DataFrame) -> DataFrame:
    """Only known verdicts signed by somebody."""
    return verdicts.where(F.col("status").isin(VALID, CHANGED) & (F.trim("responsible") != ""))


def validate_pending(items: DataFrame, dataset: str, responsible: str, lang: str) -> DataFrame:
    """Verdict rows for all pending items of a dataset."""
    return items.where((F.col("dataset") == dataset) & (F.col("status") == PENDING)).select("item_id", F.lit(lang).alias("lang"), F.lit(VALID).alias("status"), F.lit("").alias("text"), F.lit(responsible).alias("responsible"))


def curation_progress(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Items, reviewed and reviewed % (one decimal), in all or per group."""
    return items.groupBy(*(by or [])).agg(F.count("*").alias("items"), F.count_if(F.col("status") != PENDING).alias("reviewed"), F.bround(100.0 * F.avg((F.col("status") != PENDING).cast("int")), 1).alias("reviewed_pct"))


def coverage(datasets: DataFrame, assignments: DataFrame, results: DataFrame, items: DataFrame) -> DataFrame:
    """Per dataset (dataset, classification): owner_named (a named steward stands in for an owner who is none), steward_named, classified, has_rules, curation_pct.

    Items name their datasets in an array (linked_datasets), or else by a text (dataset) in which the names stand.
    """
    rules = results.groupBy("dataset").agg(F.count("*").alias("rules"))
    if "linked_datasets" in items.columns:
        linked = items.select("status", F.explode("linked_datasets").alias("dataset"))
    else:
        named = contained(items, "dataset", datasets, "dataset")
        linked = items.join(named, items["dataset"] == named["text"]).select("status", F.col("name").alias("dataset"))
    each = curation_progress(linked, ["dataset"]).select("dataset", "reviewed_pct")
    joined = datasets.join(assignments, "dataset", "left").join(rules, "dataset", "left").join(each, "dataset", "left")
    return joined.select("dataset", (named_person(F.col("owner")) | named_person(F.col("steward"))).alias("owner_named"), named_person(F.col("steward")).alias("steward_named"),
                         (F.coalesce(F.trim("classification"), F.lit("")) != "").alias("classified"), F.col("rules").isNotNull().alias("has_rules"), F.coalesce("reviewed_pct", F.lit(0.0)).alias("curation_pct"))


def governance_index(covered: DataFrame) -> DataFrame:
    """The five coverages in % (one decimal) and their mean."""
    share = lambda c: F.bround(100.0 * F.avg(F.col(c).cast("int")), 1).alias(c)
    parts = ["owner_named", "steward_named", "classified", "has_rules"]
    wide = covered.agg(*map(share, parts), F.bround(F.avg("curation_pct"), 1).alias("curation_pct"))
    return wide.withColumn("governance_index", F.bround(sum((F.col(c) for c in [*parts, "curation_pct"]), F.lit(0.0)) / 5, 1))


def policies(datasets: DataFrame, described: DataFrame, results: DataFrame, terms: DataFrame) -> DataFrame:
    """(policy_id, status, evidence): ownership, documented columns, PII classified, index, no failing rule, terms in use."""
    three = lambda ok, part: F.when(ok, "compliant").when(part, "partial").otherwise("noncompliant")
    ratio = lambda a, b: F.concat(a.cast("string"), F.lit("/"), b.cast("string"))
    n, x = F.col("n"), F.col("x")
    owned = datasets.agg(F.count("*").alias("n"), F.count_if(named_person(F.col("owner")) & named_person(F.col("steward"))).alias("x"))
    documented = described.agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("description", F.lit(""))) != "").alias("x"))
    loose = described.where("pii").select("dataset").distinct().join(datasets.where(F.col("classification") == "PII").select("dataset"), "dataset", "left_anti").agg(F.count("*").alias("x"))
    index = results.agg(F.bround(F.avg("score"), 2).alias("x"))
    fails = results.agg(F.count_if(F.col("status") == "fail").alias("x"))
    used = terms.where(F.size("linked_datasets") > 0).agg(F.count_distinct("term_id").alias("x"))
    rows = [("POL-01", owned, three(x == n, x > 0), ratio(x, n)), ("POL-02", documented, three(x == n, x > 0), ratio(x, n)), ("POL-03", loose, three(x == 0, F.lit(False)), x.cast("string")),
            ("POL-04", index, three(x >= 95, x >= 90), x.cast("string")), ("POL-05", fails, three(x == 0, F.lit(False)), x.cast("string")), ("POL-06", used, three(x >= 5, x > 0), x.cast("string"))]
    return reduce(DataFrame.unionByName, (df.select(F.lit(k).alias("policy_id"), status.alias("status"), evidence.alias("evidence")) for k, df, status, evidence in rows))


def compliance(datasets: DataFrame, results: DataFrame) -> DataFrame:
    """Per dataset: rules, passed, pct_pass, compliance (incumple on a fail, en_riesgo on a warning, else cumple)."""
    per = results.groupBy("dataset").agg(F.count("*").alias("rules"), *(F.count_if(F.col("status") == s).alias(s) for s in ("pass", "warn", "fail")))
    zero = F.lit(0)
    joined = datasets.select("dataset").join(per, "dataset", "left").select("dataset", *(F.coalesce(c, zero).alias(c) for c in ("rules", "pass", "warn", "fail")))
    state = F.when(F.col("fail") > 0, "incumple").when(F.col("warn") > 0, "en_riesgo").otherwise("cumple")
    pct = F.when(F.col("rules") == 0, 100.0).otherwise(F.bround(100.0 * F.col("pass") / F.col("rules"), 1))
    return joined.select("dataset", "rules", F.col("pass").alias("passed"), pct.alias("pct_pass"), state.alias("compliance"))


def contracts(datasets: DataFrame, results: DataFrame, consumers: DataFrame, agreements: DataFrame) -> DataFrame:
    """Per data product (datasets: dataset, domain, owner, steward, classification, source, refresh): roles, producer, consumers, refresh agreed, rule counts, compliance and whether and by whom it is signed."""
    who = consumers.select(F.col("start").alias("dataset"), F.array_join("consumers", ", ").alias("consumers"))
    counts = results.groupBy("dataset").agg(*(F.count_if(F.col("status") == s).alias(f"rules_{s}") for s in ("pass", "warn", "fail")))
    signed = agreements.select("dataset", F.nullif(F.trim("signed_by"), F.lit("")).alias("signed_by"))
    joined = datasets.join(compliance(datasets, results), "dataset").join(counts, "dataset", "left").join(who, "dataset", "left").join(signed, "dataset", "left")
    zero = F.lit(0)
    return joined.select("dataset", "domain", F.col("owner").alias("domain_owner"), F.col("steward").alias("product_owner"), F.col("source").alias("producer"), F.coalesce("consumers", F.lit("—")).alias("consumers"),
                         F.col("refresh").alias("sla_refresh"), "classification", "rules", *(F.coalesce(f"rules_{s}", zero).alias(f"rules_{s}") for s in ("pass", "warn", "fail")), "pct_pass", "compliance",
                         F.when(F.col("signed_by").isNotNull(), "vigente").otherwise("borrador").alias("agreement"), F.coalesce("signed_by", F.lit("")).alias("signed_by"))


def with_remedy(issues: DataFrame, remedies: DataFrame) -> DataFrame:
    """issues with an action: the rule's own, else its dimension's, else that of completeness (remedies: scope, key, action; of several for one key the first by name)."""
    remedies = remedies.groupBy("scope", "key").agg(F.min("action").alias("action"))
    of = lambda scope, name: remedies.where(F.col("scope") == scope).select(F.col("key").alias(name), F.col("action").alias(f"_{name}"))
    fallback = remedies.where((F.col("scope") == "dimension") & (F.col("key") == "completeness")).agg(F.min("action").alias("_any"))
    joined = issues.join(of("rule", "rule_id"), "rule_id", "left").join(of("dimension", "dimension"), "dimension", "left").crossJoin(F.broadcast(fallback))
    return joined.withColumn("action", F.coalesce("_rule_id", "_dimension", "_any")).drop("_rule_id", "_dimension", "_any")


def alerts(results: DataFrame, datasets: DataFrame, consumers: DataFrame, remedies: DataFrame) -> DataFrame:
    """One row per rule that does not pass on a known dataset, failing ones first."""
    who = consumers.select(F.col("start").alias("dataset"), F.array_join("consumers", ", ").alias("impact"))
    issues = with_remedy(results.where("status <> 'pass'"), remedies).join(datasets.select("dataset", "owner", "steward"), "dataset").join(who, "dataset", "left")
    notify = F.when(F.col("status") == "warn", F.col("steward")).otherwise(F.concat_ws(", ", "owner", "steward"))
    return issues.select("rule_id", "dataset", F.when(F.col("status") == "warn", "media").otherwise("alta").alias("severity"), notify.alias("notify"), F.coalesce("impact", F.lit("—")).alias("impact"), "action", "affected_rows").orderBy("severity", "dataset", "rule_id")


def contract_kpis(table: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: products, by compliance, signed ones, and alerts."""
    wide = table.agg(F.count("*").alias("products"), *(F.count_if(F.col("compliance") == s).alias(s) for s in ("cumple", "en_riesgo", "incumple")), F.count_if(F.col("agreement") == "vigente").alias("signed"))
    return wide.crossJoin(alerts.agg(F.count("*").alias("alerts")))


def org_table(raw: DataFrame, spellings: DataFrame) -> DataFrame:
    """(name, title, area, manager) from a chart; spellings (field, spelling) tells which headers stand for a field, the first spelling by its order (priority) first.

    Headers are compared folded. Blank names go; a missing name, title or area raises; other
    missing fields are empty.
    """
    headers = raw.sparkSession.createDataFrame([(c, k) for k, c in enumerate(raw.columns)], "header string, position int")
    hit = headers.join(spellings, folded(F.col("header")) == folded(F.col("spelling")))
    chosen = {r["field"]: r["header"] for r in hit.groupBy("field").agg(F.min_by("header", F.struct("priority", "position")).alias("header")).collect()}  # one row per field
    if missing := [k for k in ("name", "title", "area") if k not in chosen]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    value = lambda k: F.trim(F.coalesce(F.col(f"`{chosen[k]}`").cast("string"), F.lit(""))) if k in chosen else F.lit("")
    return raw.select(*(value(k).alias(k) for k in ("name", "title", "area", "manager"))).where("name <> ''")


def suggested_owners(datasets: DataFrame, people: DataFrame, keywords: DataFrame, data_team: DataFrame) -> DataFrame:
    """owner and steward per dataset (dataset, domain): the two most senior people (ties by name) of the first area that fits.

    keywords (domain, keyword, priority) are tried in their order; then all areas with a
    keyword of the data team (keyword); then everybody. Keywords and areas are compared folded.
    """
    last = 1 << 20
    hints = datasets.join(keywords, "domain").select("dataset", folded(F.col("keyword")).alias("keyword"), "priority")
    hints = hints.unionByName(datasets.select("dataset").crossJoin(data_team.select(folded(F.col("keyword")).alias("keyword"))).withColumn("priority", F.lit(last)))
    ranked = people.select("name", folded(F.col("area")).alias("area"), seniority(F.col("title")).alias("level"))
    fit = contained(ranked, "area", hints, "keyword").toDF("area", "keyword")
    areas = hints.join(fit, "keyword").groupBy("dataset", "area").agg(F.min("priority").alias("priority"))
    areas = areas.selectExpr("*", "min(priority) over (partition by dataset) as top").where("priority = top")
    # of each area its two first are enough
    two = ranked.selectExpr("*", "row_number() over (partition by area order by level desc, name) as k").where("k <= 2").drop("k")
    anyone = ranked.orderBy(F.desc("level"), "name").limit(2)
    pool = areas.join(two, "area").select("dataset", "name", "level", F.when(F.col("priority") < last, "domain").otherwise("data_team").alias("match"))
    rest = datasets.select("dataset").join(areas, "dataset", "left_anti").crossJoin(anyone).select("dataset", "name", "level", F.lit("all").alias("match"))
    best = pool.unionByName(rest).selectExpr("*", "row_number() over (partition by dataset order by level desc, name) as k").where("k <= 2")
    return best.groupBy("dataset").agg(F.min_by("name", "k").alias("owner"), F.max_by("name", "k").alias("steward"), F.first("match").alias("match"), F.lit("sugerido").alias("state"))


def combined(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Union of governance tables by name; columns missing on one side are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rest, first)


def case_kpis(catalog: DataFrame, results: DataFrame, described: DataFrame, items: DataFrame) -> DataFrame:
    """Per dataset of the catalog: rows, columns, quality index, rules in all, passed and failed, documented %, PII columns, and curation reviewed, total and %."""
    q = results.groupBy("dataset").agg(F.bround(F.avg("score"), 2).alias("quality_index"), F.count("*").alias("rules_total"), *(F.count_if(F.col("status") == s).alias(f"rules_{s}") for s in ("pass", "fail")))
    d = described.groupBy("dataset").agg(F.bround(100.0 * F.avg((F.trim(F.coalesce("description", F.lit(""))) != "").cast("int")), 1).alias("documented_pct"), F.count_if("pii").alias("pii_columns"))
    c = curation_progress(items, ["dataset"]).select("dataset", F.col("reviewed_pct").alias("curation_pct"), F.col("reviewed").alias("curation_reviewed"), F.col("items").alias("curation_total"))
    joined = catalog.select("dataset", "rows", "columns").join(q, "dataset", "left").join(d, "dataset", "left").join(c, "dataset", "left")
    none = {"rules_total": 0, "rules_pass": 0, "rules_fail": 0, "documented_pct": 0.0, "pii_columns": 0, "curation_pct": 0.0, "curation_reviewed": 0, "curation_total": 0}
    return joined.fillna(none)


def case_lineage(cases: DataFrame) -> DataFrame:
    """(source, source_layer, target, target_layer) of cases (dataset, source, report): source to dataset to report."""
    a = cases.select("source", F.lit("source").alias("source_layer"), F.col("dataset").alias("target"), F.lit("curated").alias("target_layer"))
    b = cases.select(F.col("dataset").alias("source"), F.lit("curated").alias("source_layer"), F.col("report").alias("target"), F.lit("bi").alias("target_layer"))
    return a.unionByName(b).distinct()


def bundle(metadata: DataFrame, tables: dict[str, DataFrame], described: DataFrame, results: DataFrame, nodes: DataFrame, edges: DataFrame, terms: DataFrame, lang: str = "en") -> dict[str, DataFrame]:
    """The nine governance tables of a set of governed tables, each lazy; write them with sources.files.write_bundle."""
    listed = catalog(metadata, tables, lang)
    totals = results.agg(F.bround(F.avg("score"), 2).alias("quality_index")).select(F.lit("quality_index").alias("kpi"), F.col("quality_index").alias("value"))
    return {
        "catalog": listed, "dictionary": described, "quality_results": results, "quality_by_dataset": scores.by_dataset(results), "quality_by_dimension": scores.by_dimension(results),
        "lineage": lineage.labelled(nodes, edges), "glossary": glossary(terms, lang), "policies": policies(listed, described, results, terms),
        "kpis": totals.unionByName(scores.kpis(results).withColumn("value", F.col("value").cast("double"))),
    }
