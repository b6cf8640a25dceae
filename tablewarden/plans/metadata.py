"""Registered queries over metadata: ownership, policies, contracts, exports, BI models, sources and stages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import bi_models, exports, governance, mdm, profile, protect, scores
from ..sources import files
from ..sources.scratch import scratch_dir, written
from .catalog import (_CURATED, _DATASETS, _LINKS, _NAMED, AFTER, BEFORE, CTE, DERIVED, RESULTS, _datasets, _described, _edges, _feeds, _items, _nodes, _remedies, _scan, _terms, _verdicts, all_tables, described_sql,
                      load, query, results, rules, tenant_scan)
from .catalog import _people as _clustered

COLUMNS = described_sql(*DERIVED)
_ABOUT = "case when length(\"column\") > 4 then concat('about ', \"column\") end"


# --- protection and dictionaries -------------------------------------------------------------------------------------------------

query("p6_pii_columns", f'select dataset, "column" from {COLUMNS} where pii')(lambda s, d: protect.pii_columns(_described(s, d)))
query("f17_classification_groups", f"""select classification, array_to_string(list_sort(list(distinct concat(dataset, '.', "column"))), '; ') as columns from (select *, case when regexp_matches(lower("column"), 'mail|correo') then 'email'
  when regexp_matches(lower("column"), 'phone|mobile|telefono') then 'phone' when regexp_matches(lower("column"), 'passport|dni|ssn|cedula|document') then 'identity' when regexp_matches(lower("column"), 'birth|nacimiento') then 'birth'
  when regexp_matches(lower("column"), 'address|direccion|zip') then 'address' when regexp_matches(lower("column"), 'name|nombre|surname|apellido') then 'name' else 'other' end as classification from {COLUMNS} where pii) group by classification""")(
    lambda s, d: exports.classification_groups(_described(s, d)))
query("g20_entities", f"""select dataset as qualified_name, 'table' as kind, dataset as name, cast(null as varchar) as parent, concat('tabla ', dataset) as description from (select distinct dataset from {COLUMNS})
  union all select concat(dataset, '.', "column"), 'column', "column", dataset, {_ABOUT} from {COLUMNS}""")(lambda s, d: exports.entities(governance.catalog(_datasets(s), {k: load(s, d, k) for k in DERIVED}), _described(s, d)))
query("g3_glossary_drafts", f"""select concat('db1:', dataset, '.', "column") as term_id, replace(regexp_replace(regexp_replace("column", '^c_', 'customer_'), '^o_', 'order_'), '_', ' ') as term, regexp_matches("column", '^[co]_') as expanded, dataset as "table" from {described_sql('customer', 'orders')}""")(
    lambda s, d: exports.glossary_drafts(governance.dictionary({k: load(s, d, k) for k in ("customer", "orders")}).select(F.lit("db1").alias("conn_id"), F.col("dataset").alias("table"), "column"), {"c": "customer", "o": "order"}))
query("p10_access_plan", "select n_name as dataset, c.classification, role from (select n_name, case n_nationkey % 3 when 0 then 'PII' when 1 then 'internal' else '' end as classification from nation) c left join (values ('PII', 'privacy'), ('internal', 'analyst'), ('internal', 'privacy')) r(classification, role) on r.classification = c.classification")(
    lambda s, d: protect.access_plan(load(s, d, "nation").selectExpr("n_name as dataset", "case n_nationkey % 3 when 0 then 'PII' when 1 then 'internal' else '' end as classification"), s.createDataFrame([("PII", "privacy"), ("internal", "analyst"), ("internal", "privacy")], "classification string, role string")))
query("p9_one_value", CTE + " select c_custkey, nation from customer_d where nation = 3")(lambda s, d: protect.row_policy(load(s, d, "customer_d"), "nation", 3).select("c_custkey", "nation"))


# --- policies, contracts, owners ---------------------------------------------------------------------------------------------------

query("g11_policies", RESULTS + ", " + _DATASETS + f""", o as (select count(*) as n, count(*) filter (where {_NAMED.format(c='owner')} and {_NAMED.format(c='steward')}) as x from datasets), c as (select count(*) as n, count(*) filter (where length("column") > 4) as x from {COLUMNS}),
  l as (select count(distinct dataset) as x from {COLUMNS} where pii and dataset not in (select dataset from datasets where classification = 'PII')), i as (select round_even(avg(score), 2) as x, count(*) filter (where status = 'fail') as f from results), t as (select count(*) filter (where r_regionkey <> 0) as x from region)
  select 'POL-01' as policy_id, case when x = n then 'compliant' when x > 0 then 'partial' else 'noncompliant' end as status, concat(x, '/', n) as evidence from o union all select 'POL-02', case when x = n then 'compliant' when x > 0 then 'partial' else 'noncompliant' end, concat(x, '/', n) from c
  union all select 'POL-03', case when x = 0 then 'compliant' else 'noncompliant' end, concat(x) from l union all select 'POL-04', case when x >= 95 then 'compliant' when x >= 90 then 'partial' else 'noncompliant' end, concat(x) from i
  union all select 'POL-05', case when f = 0 then 'compliant' else 'noncompliant' end, concat(f) from i union all select 'POL-06', case when x >= 5 then 'compliant' when x > 0 then 'partial' else 'noncompliant' end, concat(x) from t""")(
    lambda s, d: governance.policies(_datasets(s), _described(s, d), results(s, d), _terms(s, d)))
query("j12_unclassified_pii", f"with {_DATASETS} select distinct dataset from {COLUMNS} where pii and dataset not in (select dataset from datasets where classification = 'PII')")(
    lambda s, d: _described(s, d).where("pii").select("dataset").distinct().join(_datasets(s).where("classification = 'PII'").select("dataset"), "dataset", "left_anti"))


def _contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _datasets(spark).withColumn("domain", names.localized(F.col("domain"), "en"))
    return governance.contracts(base, results(spark, sf_dir), _feeds(spark), spark.createDataFrame([("orders_d", "Ana Ruiz"), ("events_d", " ")], "dataset string, signed_by string"))


_CONTRACTS = RESULTS + ", " + _DATASETS + """, n as (select d.dataset, count(rule_id) as rules, count(*) filter (where status = 'pass') as p, count(*) filter (where status = 'warn') as w, count(*) filter (where status = 'fail') as f from datasets d left join results r on r.dataset = d.dataset group by d.dataset),
  contracts as (select d.dataset, domain, owner as domain_owner, steward as product_owner, source as producer, case d.dataset when 'customer_d' then 'Sales board, Churn' when 'orders_d' then 'Sales board' else '—' end as consumers, refresh as sla_refresh, classification, rules, p as rules_pass, w as rules_warn, f as rules_fail,
  case when rules = 0 then 100.0 else round_even(100.0 * p / rules, 1) end as pct_pass, case when f > 0 then 'incumple' when w > 0 then 'en_riesgo' else 'cumple' end as compliance, case when d.dataset = 'orders_d' then 'vigente' else 'borrador' end as agreement, case when d.dataset = 'orders_d' then 'Ana Ruiz' else '' end as signed_by
  from datasets d join n on n.dataset = d.dataset) """
query("g13_contracts", _CONTRACTS + "select * from contracts")(_contracts)
query("g15_contract_kpis", _CONTRACTS + "select count(*) as products, count(*) filter (where compliance = 'cumple') as cumple, count(*) filter (where compliance = 'en_riesgo') as en_riesgo, count(*) filter (where compliance = 'incumple') as incumple, count(*) filter (where agreement = 'vigente') as signed, (select count(*) from results where status <> 'pass' and dataset in (select dataset from datasets)) as alerts from contracts")(
    lambda s, d: governance.contract_kpis(_contracts(s, d), governance.alerts(results(s, d), _datasets(s), _feeds(s), _remedies(s))))
query("g18_case_kpis", RESULTS + ", " + _DATASETS + ", " + _CURATED + f""", n as (select 'customer_d' as dataset, count(*) as rows from customer_d union all select 'orders_d', count(*) from orders_d union all select 'lineitem_d', count(*) from lineitem_d union all select 'events_d', count(*) from events_d),
  c as (select dataset, count(*) as columns, round_even(100.0 * count(*) filter (where length("column") > 4) / count(*), 1) as documented_pct, count(*) filter (where pii) as pii_columns from {COLUMNS} group by dataset),
  q as (select dataset, round_even(avg(score), 2) as quality_index, count(*) as rules_total, count(*) filter (where status = 'pass') as rules_pass, count(*) filter (where status = 'fail') as rules_fail from results group by dataset),
  u as (select dataset, round_even(100.0 * count(*) filter (where status <> 'sugerido_ia') / count(*), 1) as curation_pct, count(*) filter (where status <> 'sugerido_ia') as curation_reviewed, count(*) as curation_total from curated group by dataset)
  select dataset, rows, columns, quality_index, coalesce(rules_total, 0) as rules_total, coalesce(rules_pass, 0) as rules_pass, coalesce(rules_fail, 0) as rules_fail, documented_pct, pii_columns, coalesce(curation_pct, 0.0) as curation_pct, coalesce(curation_reviewed, 0) as curation_reviewed, coalesce(curation_total, 0) as curation_total
  from datasets join n using (dataset) join c using (dataset) left join q using (dataset) left join u using (dataset)""")(
    lambda s, d: governance.case_kpis(governance.catalog(_datasets(s), {k: load(s, d, k) for k in DERIVED}), results(s, d), _described(s, d), governance.curation(_items(s, d), _verdicts(s, d), "en")))
query("g18_case_lineage", "select concat('erp', n_regionkey) as source, 'source' as source_layer, n_name as target, 'curated' as target_layer from nation union select n_name, 'curated', concat('report ', n_regionkey), 'bi' from nation")(
    lambda s, d: governance.case_lineage(load(s, d, "nation").selectExpr("n_name as dataset", "concat('erp', n_regionkey) as source", "concat('report ', n_regionkey) as report")))
SPELLINGS = [("name", "Nombre", 1), ("name", "Name", 2), ("title", "Cargo", 1), ("title", "Título", 2), ("area", "Departamento", 1), ("manager", "Jefe", 1)]


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = load(spark, sf_dir, "supplier").selectExpr("case when s_suppkey % 13 = 0 then '  ' else concat(' ', s_name) end as Nombre", "case when s_suppkey % 7 = 0 then 'Director' when s_suppkey % 3 = 0 then 'Manager' else 'Analyst' end as `titulo `", "case when s_nationkey % 3 = 0 then 'Área de SALES' when s_nationkey % 3 = 1 then 'Data office' else 'Plant' end as DEPARTAMENTO")
    return governance.org_table(raw, spark.createDataFrame(SPELLINGS, "field string, spelling string, priority int"))


query("g7_org_table", "select s_name as name, case when s_suppkey % 7 = 0 then 'Director' when s_suppkey % 3 = 0 then 'Manager' else 'Analyst' end as title, case s_nationkey % 3 when 0 then 'Área de SALES' when 1 then 'Data office' else 'Plant' end as area, '' as manager from supplier where s_suppkey % 13 <> 0")(_people)
query("g8_suggested_owners", """with p as (select s_name as name, case when s_suppkey % 7 = 0 then 4 when s_suppkey % 3 = 0 then 3 else 1 end as level, case s_nationkey % 3 when 0 then 'area de sales' when 1 then 'data office' else 'plant' end as area from supplier where s_suppkey % 13 <> 0),
  h as (select * from (values ('customer_d', 'crm', 1), ('customer_d', 'sales', 2), ('customer_d', 'plant', 3), ('customer_d', 'data', 9), ('events_d', 'data', 9)) v(dataset, keyword, priority)), m as (select dataset, priority, name, level from h join p on contains(area, keyword)),
  a as (select * from m where priority = (select min(priority) from m m2 where m2.dataset = m.dataset)), r as (select *, row_number() over (partition by dataset order by level desc, name) as k from a),
  x as (select 'none' as dataset, name, 0 as priority, row_number() over (order by level desc, name) as k from p), b as (select dataset, name, priority, k from r union all select dataset, name, priority, k from x)
  select dataset, max(name) filter (where k = 1) as owner, coalesce(max(name) filter (where k = 2), max(name) filter (where k = 1)) as steward, case when dataset = 'none' then 'all' when min(priority) = 9 then 'data_team' else 'domain' end as match, 'sugerido' as state from b where k <= 2 and dataset <> 'none' group by dataset""")(
    lambda s, d: governance.suggested_owners(s.createDataFrame([("customer_d", "Sales"), ("events_d", "Web")], "dataset string, domain string"), _people(s, d), s.createDataFrame([("Sales", "CRM", 1), ("Sales", "Sáles", 2), ("Sales", "plant", 3)], "domain string, keyword string, priority int"), s.createDataFrame([("DATA",)], "keyword string")))
query("g6_accepted_verdicts", "select concat('I', p_partkey) as item_id, case when p_partkey % 3 = 0 then 'modificado' else 'validado' end as status from part where p_partkey % 5 = 0 and p_partkey % 4 <> 0 and p_partkey % 6 <> 0")(
    lambda s, d: governance.accepted_verdicts(_verdicts(s, d).selectExpr("item_id", "case when cast(substr(item_id, 2) as bigint) % 4 = 0 then 'other' else status end as status", "case when cast(substr(item_id, 2) as bigint) % 6 = 0 then ' ' else responsible end as responsible")).select("item_id", "status"))
query("g16_agreements", "select n_name as dataset, case when n_nationkey % 2 = 0 then 'new' else 'old' end as signed_by from nation where n_nationkey % 5 <> 0")(
    lambda s, d: governance.removed(governance.merged(load(s, d, "nation").selectExpr("n_name as dataset", "'old' as signed_by", "1 as stamp"), load(s, d, "nation").where("n_nationkey % 2 = 0").selectExpr("n_name as dataset", "'new' as signed_by", "2 as stamp"), ["dataset"], "stamp"), load(s, d, "nation").where("n_nationkey % 5 = 0").selectExpr("n_name as dataset"), ["dataset"]).select("dataset", "signed_by"))
query("g4_known_sources", "select n_name as id, case when n_nationkey % 2 = 0 then 'changed' else 'first' end as text from nation")(
    lambda s, d: governance.merged(load(s, d, "nation").selectExpr("n_name as id", "'first' as text", "1 as stamp", "'a' as source"), load(s, d, "nation").selectExpr("n_name as id", "'changed' as text", "2 as stamp", "case when n_nationkey % 2 = 0 then 'a' else 'unknown' end as source"), ["id"], "stamp", ["a", "b"]).select("id", "text"))
query("u1_combined", f'select dataset, "column", cast(null as varchar) as note from {COLUMNS} union all select n_name, cast(null as varchar), concat(\'nation \', n_regionkey) from nation')(
    lambda s, d: governance.combined(_described(s, d).select("dataset", "column"), load(s, d, "nation").selectExpr("n_name as dataset", "concat('nation ', n_regionkey) as note")))
query("j4_catalog_quality", RESULTS + ", " + _DATASETS + ", q as (select dataset, round_even(avg(score), 2) as quality from results group by dataset) select dataset, owner, quality from datasets left join q using (dataset)")(lambda s, d: scores.with_quality(_datasets(s).select("dataset", "owner"), results(s, d)))
query("j5_impact_by_dimension", CTE + ", b as (select round_even(100.0 * count(priority) / count(*), 2) as i from orders_d), a as (select round_even(100.0 * count(o_orderpriority) / count(*), 2) as i from orders) select 'completeness' as dimension, 'before' as moment, i as quality from b union all select 'completeness', 'after', i from a")(
    lambda s, d: scores.impact_by_dimension(rules.evaluate_rules(s, [BEFORE], all_tables(s, d)), rules.evaluate_rules(s, [AFTER], all_tables(s, d))))
query("f11_distinct_counts", "select count(distinct nullif(trim(n_name), '')) as stewards, count(distinct n_regionkey) as owners, (select count(distinct p_brand) from part where p_partkey % 2 = 0) as terms_in_use from nation")(
    lambda s, d: scores.distinct_counts(load(s, d, "nation").selectExpr("n_name as steward", "cast(n_regionkey as string) as owner"), load(s, d, "part").selectExpr("case when p_partkey % 2 = 0 then p_brand else ' ' end as business_term")))


# --- entity resolution ---------------------------------------------------------------------------------------------------------------

HINTS = [("email", 3.0, True), ("_id", 3.0, True), ("key", 2.5, True), ("name", 1.0, False), ("phone", 1.0, False)]
_hints = lambda s: s.createDataFrame(HINTS, "hint string, weight double, strong boolean")
query("m1_match_table", """with c as (select column_name as c, column_type as t from (describe select """ + ", ".join(DERIVED["customer_d"][1]) + """ from customer)), s as (select c, t, case when contains(lower(c), 'email') then 3.0 when contains(lower(c), '_id') then 3.0 when contains(lower(c), 'key') then 2.5 end as sure, regexp_matches(lower(c), 'email|_id|key|name|phone') as telling from c)
  select c as "column", case when sure is null and t = 'VARCHAR' then 'fuzzy' else 'exact' end as kind, cast(coalesce(sure, case when t = 'VARCHAR' then 1.0 else 1.5 end) as double) as weight, cast(case when sure is null and t = 'VARCHAR' then 0.85 end as double) as threshold, telling from s""")(
    lambda s, d: mdm.match_table(profile.profile_table(load(s, d, "customer_d"), "c_custkey"), _hints(s)))


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations paired without blocking and scored by the matches chosen from their profile."""
    df = load(spark, sf_dir, "nation").withColumnRenamed("n_name", "name")
    found = mdm.chosen_matches(mdm.match_table(profile.profile_table(df, "n_nationkey"), _hints(spark)), df.columns)
    return mdm.scored_pairs(mdm.candidate_pairs(df, "n_nationkey", None, [m.column for m in found]), "n_nationkey", found).where("score > 0.2").select("a", "b", F.bround("score", 6).alias("score"))


query("j3_all_pairs", """with p as (select a.n_nationkey as a, b.n_nationkey as b, 1 - levenshtein(lower(trim(a.n_name)), lower(trim(b.n_name))) / greatest(length(trim(a.n_name)), length(trim(b.n_name))) as r, a.n_regionkey = b.n_regionkey as e from nation a join nation b on a.n_nationkey < b.n_nationkey)
  , s as (select a, b, (case when r >= 0.85 then r else 0 end + case when e then 2.5 else 0 end) / 6.0 as score from p) select a, b, round_even(score, 6) as score from s where score > 0.2""")(_chosen)
query("m4_members", _LINKS + "select node, component from members")(lambda s, d: _clustered(s, d)[1])


# --- exports -------------------------------------------------------------------------------------------------------------------------

query("g20_terms", "with " + _CURATED + "select concat('I', p_partkey) as term_id, p_name as term, p_type as definition, case when status in ('validado', 'modificado') then 'Approved' else 'Draft' end as status from part left join curated on item_id = concat('I', p_partkey)")(
    lambda s, d: exports.exported_terms(load(s, d, "part").selectExpr("concat('I', p_partkey) as term_id", "p_name as term", "p_type as definition"), governance.curation(_items(s, d), _verdicts(s, d), "en")))
query("j14_external_ids", f'select concat(dataset, \'.\', "column") as qualified_name, "column" as name, concat(\'guid\', length("column")) as guid from {COLUMNS} where length("column") % 2 = 0')(
    lambda s, d: exports.with_external_ids(_described(s, d).selectExpr("concat(dataset, '.', column) as qualified_name", "column as name"), _described(s, d).where("length(column) % 2 = 0").selectExpr("concat(dataset, '.', column) as qualified_name", "concat('guid', length(column)) as guid")))
query("g21_label_plan", """select n_name as dataset, case when n_nationkey % 4 <> 0 then concat('/data/', n_nationkey) end as path, case n_nationkey % 3 when 0 then 'Secret' when 1 then 'General' end as label,
  case when n_nationkey % 4 = 0 then 'skipped' when n_nationkey % 3 = 2 then 'no label' else 'planned' end as state from nation""")(
    lambda s, d: exports.label_plan(load(s, d, "nation").selectExpr("n_name as dataset", "case n_nationkey % 3 when 0 then 'PII and internal' when 1 then 'Internal' else 'open' end as classification"), load(s, d, "nation").where("n_nationkey % 4 <> 0").selectExpr("n_name as dataset", "concat('/data/', n_nationkey) as path"),
                                    s.createDataFrame([("General", "internal", 2), ("Secret", "pii", 1)], "label string, hint string, priority int")))


def _report(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return exports.file_report(spark, load(spark, sf_dir, "events_d"), "events_d", _remedies(spark), "event_id")


_EVENTS = """, e as (select count(*) as n, count(*) - count(value) as nulls, count(*) - count(distinct event_id) as twice, count(*) - (select count(*) from (select distinct * from events_d)) as same from events_d),
  r as (select 'AUTO-01' as rule_id, 'event_id' as "column", 'event_id does not repeat' as description, 'uniqueness' as dimension, round_even(100.0 * (n - twice) / n, 2) as score, 100.0 as t from e union all select 'AUTO-02', 'value', 'value is filled in', 'completeness', round_even(100.0 * (n - nulls) / n, 2), 95.0 from e
  union all select 'AUTO-03', '*', 'no row repeats', 'uniqueness', round_even(100.0 * (n - same) / n, 2), 98.0 from e) """
query("g19_report_fixes", CTE + _EVENTS + "select rule_id, \"column\", description, concat('look into ', dimension) as action from r where score < t")(lambda s, d: _report(s, d)["fixes"])
query("g19_report_summary", CTE + _EVENTS + """select 'dataset' as field, 'events_d' as value union all select 'rows', concat(n) from e union all select 'columns', '5' union all select 'duplicate_rows', concat(same) from e union all select 'null_cells', concat(round_even(100.0 * nulls / (n * 5), 2), '%') from e
  union all select 'quality', concat(round_even(avg(score), 2), ' / 100') from r union all select 'rules_passed', concat(count(*) filter (where score >= t), ' / ', count(*)) from r union all select 'pii_columns', '—'""")(lambda s, d: _report(s, d)["summary"])


def _bundle(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return governance.bundle(_datasets(spark), {k: load(spark, sf_dir, k) for k in DERIVED}, _described(spark, sf_dir), written(results(spark, sf_dir)), _nodes(spark, sf_dir), _edges(spark, sf_dir), _terms(spark, sf_dir))


def _written_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine tables written together and read again, each with its number of rows."""
    path, tables = scratch_dir(spark), _bundle(spark, sf_dir)
    files.write_bundle(tables, path)
    counts = [spark.read.parquet(f"{path}/{k}").agg(F.count("*").alias("rows")).select(F.lit(k).alias("table"), "rows") for k in tables]
    return governance.combined(*counts)


query("s15_bundle", RESULTS + f""", n as (select count(*) as r, count(distinct dataset) as d, count(distinct dimension) as m from results) select 'catalog' as "table", 4 as rows union all select 'dictionary', count(*) from {COLUMNS} union all select 'quality_results', r from n union all select 'quality_by_dataset', d from n
  union all select 'quality_by_dimension', m from n union all select 'lineage', (select count(*) from nation join region on n_regionkey = r_regionkey) + (select count(*) from supplier join nation on s_nationkey = n_nationkey) union all select 'glossary', count(*) from region union all select 'policies', 6 union all select 'kpis', 5""")(_written_bundle)


# --- BI models -----------------------------------------------------------------------------------------------------------------------

query("b4_tenant_dictionary", "select r_name as dataset, concat(n_name, '.', c) as \"column\", t as type, c = 'email' as pii, case when c = 'email' then 'e-mail' end as description from nation join region on r_regionkey = n_regionkey, (values ('S1', 'Int64'), ('email', 'String')) v(c, t)")(lambda s, d: bi_models.tenant_dictionary(_scan(s, d)))
_MEASURES = "select concat('M', lpad(cast(k as varchar), cast(greatest(3, length(cast(k as varchar))) as int), '0')) as term_id, model as dataset, s_name as term, concat('SUM ( Sales[S', s_suppkey % 4, '] )') as definition from (select *, r_name as model, row_number() over (partition by r_name order by s_name) as k from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"
query("b5_tenant_terms", _MEASURES)(lambda s, d: bi_models.numbered_terms(_scan(s, d)["measures"], "M", "model", "measure", "expression"))


def _counted(tables: dict[str, DataFrame]) -> DataFrame:
    return governance.combined(*(df.agg(F.count("*").alias("rows")).select(F.lit(k).alias("table"), "rows") for k, df in tables.items()))


_PER = "(select count(distinct n_regionkey) from nation)"
query("b9_tenant_tables", f"""select 'catalog' as "table", {_PER} as rows union all select 'dictionary', 2 * (select count(*) from nation) union all select 'glossary', (select count(*) from supplier join nation on s_nationkey = n_nationkey) union all select 'lineage', 2 * (select count(*) from nation) + {_PER} union all select 'quality', 5 * {_PER}""")(
    lambda s, d: _counted(bi_models.tenant_governance(_scan(s, d))))
query("b9_no_models", "select t as \"table\", 0 as rows from (values ('catalog'), ('dictionary'), ('glossary'), ('lineage'), ('quality')) v(t) where (select count(*) from region where r_regionkey < 0) = 0")(
    lambda s, d: _counted(bi_models.tenant_governance(bi_models.tenant_tables(tenant_scan(s, d).where("workspaces[0].name = ''")))))


def site_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site metadata put together from the driver's tables: a site per region, a workbook per nation on one of three datasources, every fifth on none."""
    n = load(spark, sf_dir, "nation").selectExpr("n_regionkey", """named_struct('name', n_name, 'projectName', 'p', 'upstreamDatasources', if(n_nationkey % 5 = 0, array(), array(named_struct('name', concat('ds', n_nationkey % 3),
      'fields', array(named_struct('name', 'Amount', 'description', if(n_nationkey % 4 = 0, 'sum', ''), 'formula', 'SUM( q )'), named_struct('name', 'Total', 'description', string(null), 'formula', 'sum(  q )'), named_struct('name', 'email', 'description', 'e-mail', 'formula', string(null))),
      'upstreamTables', if(n_nationkey % 2 = 0, array(named_struct('name', concat('t', n_nationkey), 'schema', 's', 'database', named_struct('name', 'db', 'connectionType', 'pg'))), array()))))) as w""")
    w = n.groupBy("n_regionkey").agg(F.struct(F.collect_list("w").alias("workbooks")).alias("data"))
    return w.join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("site"), "data")


_site = lambda s, d: bi_models.site_tables(site_metadata(s, d))
_SITE = "with w as (select r_name as site, n_name as wb, n_nationkey as k from nation join region on n_regionkey = r_regionkey), l as (select site, wb, concat('ds', k % 3) as ds, k from w where k % 5 <> 0), once as (select site, ds, min_by(k, wb) as k from l group by site, ds) "
query("b2_site_fields", _SITE + "select site, ds as model, f as field, case when f = 'email' then 'e-mail' when f = 'Amount' and k % 4 = 0 then 'sum' else '' end as description, x as formula from once, (values ('Amount', 'SUM( q )'), ('Total', 'sum(  q )'), ('email', '')) v(f, x)")(lambda s, d: _site(s, d)["fields"])
query("b3_site_catalog", _SITE + "select ds as dataset, site, 'PII' as classification, case when k % 2 = 0 then 1 else 0 end as tables, 3 as columns from once")(lambda s, d: bi_models.site_catalog(_site(s, d)))
query("b4_site_dictionary", _SITE + "select concat(site, '.', ds) as dataset, f as \"column\", case when f = 'email' then '' else 'calculated' end as type, f = 'email' as pii, case when f = 'email' then 'e-mail' else concat('formula: ', x) end as description from once, (values ('Amount', 'SUM( q )'), ('Total', 'sum(  q )'), ('email', '')) v(f, x)")(lambda s, d: bi_models.site_dictionary(_site(s, d)))
query("b5_site_terms", _SITE + ", r as (select site, ds, f, case when f = 'Amount' and k % 4 = 0 then 'sum' else x end as x, row_number() over (partition by site order by ds, f) as n from once, (values ('Amount', 'SUM( q )'), ('Total', 'sum(  q )')) v(f, x)) select concat('T', lpad(cast(n as varchar), cast(greatest(3, length(cast(n as varchar))) as int), '0')) as term_id, concat(site, '.', ds) as dataset, f as term, x as definition from r")(lambda s, d: bi_models.site_terms(_site(s, d)))
query("b6_site_lineage", _SITE + "select concat('s.t', k, ' (pg)') as source, 'source' as source_layer, ds as target, 'model' as target_layer from once where k % 2 = 0 union select ds, 'model', wb, 'report' from l")(lambda s, d: bi_models.site_lineage(_site(s, d)))
query("q24_site_health", _SITE + """, c as (select w.site, count(*) as wbs, (select count(*) from l where l.site = w.site) as linked, (select count(*) from once o where o.site = w.site) as ds, (select count(*) from once o where o.site = w.site and k % 2 = 0) as traced, (select count(*) from once o where o.site = w.site and k % 4 = 0) as doc from w group by w.site),
  x as (select 'TAB-01' as rule_id, site, doc as good, greatest(2 * ds, 1) as n, greatest(2 * ds, 1) - doc as bad from c union all select 'TAB-02', site, greatest(2 * ds, 1) - greatest(2 * ds - 1, 0), greatest(2 * ds, 1), greatest(2 * ds - 1, 0) from c
  union all select 'TAB-03', site, traced, greatest(ds, 1), greatest(ds, 1) - traced from c union all select 'TAB-04', site, linked, wbs, wbs - linked from c)
  select rule_id, site as dataset, round_even(100.0 * good / n, 1) as score, cast(bad as bigint) as affected_rows from x""")(lambda s, d: bi_models.site_health(_site(s, d)).select("rule_id", "dataset", "score", "affected_rows"))


# --- scalar functions -----------------------------------------------------------------------------------------------------------------

query("x5_folded", "select n_nationkey, lower(trim(concat('  Área Ñ', n_name, 'Ü '))) as raw, strip_accents(lower(trim(concat('  Área Ñ', n_name, 'Ü ')))) as folded from nation")(
    lambda s, d: load(s, d, "nation").select("n_nationkey", F.lower(F.trim(F.concat(F.lit("  Área Ñ"), "n_name", F.lit("Ü ")))).alias("raw"), names.folded(F.concat(F.lit("  Área Ñ"), "n_name", F.lit("Ü "))).alias("folded")))
query("x6_seniority", "select s_suppkey, case s_suppkey % 5 when 0 then 5 when 1 then 4 when 2 then 3 when 3 then 2 else 1 end as level from supplier")(
    lambda s, d: load(s, d, "supplier").select("s_suppkey", names.seniority(F.expr("element_at(array('CEO', 'Director comercial', 'Gerente', 'SENIOR analyst', 'clerk'), cast(s_suppkey % 5 as int) + 1)")).alias("level")))
query("x7_tokens", "select \"column\", array_to_string(string_split_regex(lower(\"column\"), '[ _.-]+'), '|') as tokens from " + described_sql("customer", "orders", "lineitem"))(
    lambda s, d: governance.dictionary({k: load(s, d, k) for k in ("customer", "orders", "lineitem")}).select("column", F.array_join(names.tokens(F.col("column")), "|").alias("tokens")))
query("x11_source_labels", "select n_nationkey, case n_nationkey % 5 when 0 then concat('srv/', n_name) when 1 then 'srv' when 2 then 'native query' when 3 then 'Snowflake' end as label from nation")(
    lambda s, d: load(s, d, "nation").select("n_nationkey", names.source_label(F.expr("""element_at(array(concat('let a = Sql.Database("srv", "', n_name, '") in a'), 'Source = Sql.Databases( "srv" )', 'x = Value.NativeQuery(Table.First(y), "select 1")', 'Table.Skip(Snowflake.Databases("acme"), 1)', 'let x = Table.FromRows({}) in x'), n_nationkey % 5 + 1)""")).alias("label")))
query("x13_named_headers", "select s_name as name from supplier where s_suppkey % 13 <> 0")(lambda s, d: _people(s, d).select("name"))
query("x14_qualified", "select n_nationkey, case when n_nationkey % 2 = 0 then concat('mssql://h.DATABASE.windows.net/db/', case when n_nationkey % 4 = 0 then 'dbo' else 's' end, '/', n_name) end as name from nation")(
    lambda s, d: load(s, d, "nation").select("n_nationkey", names.qualified_table(F.expr("if(n_nationkey % 2 = 0, 'h.DATABASE.windows.net', 'localhost')"), F.lit("db"), F.expr("if(n_nationkey % 4 = 0, '', 's')"), F.col("n_name")).alias("name")))
query("x15_filled", "select o_orderkey, concat('see ', format('{:,}', o_orderkey * 1000), ' rows of ', o_orderstatus) as text from orders")(
    lambda s, d: load(s, d, "orders").select("o_orderkey", names.filled(F.lit("see {n} rows of {col}"), F.expr("o_orderkey * 1000"), F.col("o_orderstatus")).alias("text")))
query("x16_texts", "select p_partkey, substr(p_name, 1, 5) as brief, case when p_partkey % 3 = 0 then '—' else p_brand end as dashed from part")(
    lambda s, d: load(s, d, "part").select("p_partkey", names.brief(F.col("p_name"), 5).alias("brief"), names.or_dash(F.expr("case when p_partkey % 3 = 0 then if(p_partkey % 2 = 0, ' ', null) else p_brand end")).alias("dashed")))


# --- sources and stages ----------------------------------------------------------------------------------------------------------------

def _again(spark: SparkSession, df: DataFrame, write, read) -> DataFrame:
    """df written to scratch and read back, in its own types."""
    path = scratch_dir(spark)
    write(df, path)
    return read(path).select(*(F.col(c).cast(t).alias(c) for c, t in df.dtypes))


_typed = lambda df: ", ".join(f"{c} {t}" for c, t in df.dtypes)
query("s1_csv", "select * from nation")(lambda s, d: _again(s, load(s, d, "nation"), files.write_csv, lambda p: files.read_csv(s, p)))
query("s2_delimited", "select * from nation")(lambda s, d: _again(s, load(s, d, "nation"), lambda df, p: df.write.option("header", True).option("sep", ";").csv(p), lambda p: files.read_delimited(s, p)[0]))
query("s3_by_format", "select * from supplier")(lambda s, d: _again(s, load(s, d, "supplier"), files.write_parquet, lambda p: files.read_as(s, p, "parquet")))
query("s11_json", "select o_orderkey, o_orderstatus, cast(cast(o_orderdate as date) as varchar) as day, case when o_orderkey % 3 <> 0 then o_totalprice end as total from orders")(
    lambda s, d: _again(s, load(s, d, "orders").selectExpr("o_orderkey", "o_orderstatus", "cast(o_orderdate as date) as day", "if(o_orderkey % 3 = 0, double('NaN'), o_totalprice) as total"), files.write_json, lambda p: s.read.schema("o_orderkey bigint, o_orderstatus string, day date, total double").json(p)).withColumn("day", F.col("day").cast("string")))


def _stages(spark: SparkSession, sf_dir: str) -> str:
    """Three saves: s1, s2, and s1 again in other tables."""
    root = scratch_dir(spark)
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    files.save_stage(spark, root, "c", "s1", {"old": region, "none": region.where("false")})
    files.save_stage(spark, root, "c", "s2", {"r": region})
    files.save_stage(spark, root, "c", "s1", {"n": nation, "r": region.where("r_regionkey < 2")}, "model", "again")
    return root


query("s13_stage", "select 'n' as \"table\", count(*) as rows from nation union all select 'r', count(*) from region where r_regionkey < 2")(lambda s, d: _counted(files.load_stage(s, _stages(s, d), "c", "s1")))
query("s14_stages", "select 's1' as stage_id, 'model' as kind, 2 as tables, (select count(*) from nation) + (select count(*) from region where r_regionkey < 2) as rows union all select 's2', '', 1, (select count(*) from region)")(lambda s, d: files.list_stages(s, _stages(s, d), "c").select("stage_id", "kind", "tables", "rows"))
query("f15_stage_summary", "select 2 as stages, 3 as tables, (select count(*) from nation) + (select count(*) from region where r_regionkey < 2) + (select count(*) from region) as rows")(lambda s, d: files.stage_summary(s, _stages(s, d), "c").drop("last_update"))


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of two sources, one of them empty, and the failure of a third."""
    of = lambda *t: governance.dictionary({k: load(spark, sf_dir, k) for k in t}).withColumnRenamed("dataset", "table")
    found = files.scan_sources(spark, {"a": {"name": "A", "engine": "pg", "catalog": lambda: of("customer", "nation")}, "b": {"name": "B", "engine": "pg", "catalog": lambda: of("nation").where("false")}, "c": {"name": "C", "engine": "my", "catalog": lambda: spark.read.parquet(f"{sf_dir}/no_such_table")}})
    return found.select("conn_id", "table", "column", F.col("error").isNotNull().alias("failed"))


query("s6_scan", f"select 'a' as conn_id, dataset as \"table\", \"column\", false as failed from {described_sql('customer', 'nation')} union all select 'b', null, null, false union all select 'c', null, null, true")(_listed)


def _workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook's XML written from nations, a datasource each, and read again."""
    path = scratch_dir(spark)
    load(spark, sf_dir, "nation").selectExpr("""concat('<workbook><datasource caption="', n_name, '" name="', if(n_nationkey % 6 = 0, 'Parameters', concat('f', n_nationkey)), '"><connection class="pg" server="s" dbname="d"/><column name="[amount]" datatype="real"><calculation formula="SUM( ', n_regionkey, ' )"/></column><column caption="Mail" name="[m]" datatype="string"/></datasource></workbook>') as value""").write.option("maxRecordsPerFile", 1).text(path)
    return bi_models.read_workbook(spark, path).select("datasource", "field", "datatype", "formula", "connection")


query("s9_workbook", "select n_name as datasource, f as field, t as datatype, case when f = 'amount' then concat('SUM( ', n_regionkey, ' )') end as formula, 'pg' as connection from nation, (values ('amount', 'real'), ('Mail', 'string')) v(f, t) where n_nationkey % 6 <> 0")(_workbook)


def _read_again(spark: SparkSession, df: DataFrame, read) -> DataFrame:
    path = scratch_dir(spark)
    df.write.option("maxRecordsPerFile", 1).json(path)
    return read(spark, path)


query("s7_tenant_json", _MEASURES)(lambda s, d: bi_models.numbered_terms(bi_models.tenant_tables(_read_again(s, tenant_scan(s, d), bi_models.read_tenant))["measures"], "M", "model", "measure", "expression"))
query("s8_site_json", "select distinct concat('ds', n_nationkey % 3) as model, n_name as workbook from nation where n_nationkey % 5 <> 0")(lambda s, d: bi_models.site_tables(_read_again(s, site_metadata(s, d), bi_models.read_site))["links"].select("model", "workbook"))
