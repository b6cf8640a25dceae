"""Registered queries over names inside texts, matching blocks, governed views, chains of events, and the contents of bundles, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bi_models, governance, lineage, mdm, protect
from ..operators.containment import contained
from ..sources import files
from ..sources.scratch import scratch_dir
from .catalog import _DATASETS, CTE, DERIVED, RESULTS, SQL, _datasets, _described, _scan, described_sql, load, query, results
from .metadata import _bundle, _site

# --- names inside texts ----------------------------------------------------------------------------------------------------------------

_TEXTS = """case p_partkey % 6 when 0 then 'customer_d, orders_d' when 1 then 'old lineitem_d copy' when 2 then concat('events_d/', p_brand) when 3 then 'orders' when 4 then concat(p_name, ' customer_d') else '' end"""


def _texted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated items that name their datasets in a text."""
    return load(spark, sf_dir, "part").selectExpr("concat('I', p_partkey) as item_id", f"{_TEXTS} as dataset", "if(p_partkey % 4 = 0, 'validado', 'sugerido_ia') as status")


query("j9_containment", "with " + _DATASETS + f", items as (select {_TEXTS} as text, p_partkey % 4 = 0 as done from part) select dataset, count(text) as items, cast(coalesce(round_even(100.0 * count(*) filter (where done) / nullif(count(text), 0), 1), 0.0) as double) as curation_pct from datasets left join items on contains(text, dataset) group by dataset")(
    lambda s, d: _contained_coverage(s, d))


def _contained_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and reviewed items of each dataset whose name stands in their text."""
    base, items = _datasets(spark), _texted(spark, sf_dir)
    covered = governance.coverage(base.select("dataset", "classification"), base.select("dataset", "owner", "steward"), results(spark, sf_dir), items).select("dataset", "curation_pct")
    pairs = contained(items, "dataset", base, "dataset")
    counts = items.join(pairs, items["dataset"] == pairs["text"]).groupBy(F.col("name").alias("dataset")).agg(F.count("*").alias("items"))
    return covered.join(counts, "dataset", "left").select("dataset", F.coalesce("items", F.lit(0)).alias("items"), "curation_pct")



# --- matching blocks -------------------------------------------------------------------------------------------------------------------

@query("x10_matching_blocks")
def matched_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of one nation by the ratio of matching blocks of their names; tested against the standard library on all pairs."""
    matches = [mdm.Match("s_name", 1.0, "blocks", 0.9), mdm.Match("s_acctbal", 1.5)]
    return mdm.block_scores(load(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey", matches, named=False).select("a", "b", F.bround("score", 9).alias("score"))


# --- governed views --------------------------------------------------------------------------------------------------------------------

def _views(spark: SparkSession, sf_dir: str, user: str) -> dict[str, str]:
    """Views of two tables: Leo is an analyst of three nations, Ana of privacy, Eva nobody."""
    tables = {k: load(spark, sf_dir, k) for k in ("customer_d", "orders_d")}
    plan = protect.access_plan(_datasets(spark).select("dataset", "classification"), spark.createDataFrame([("PII", "privacy"), ("PII", "analyst"), ("internal", "analyst")], "classification string, role string"))
    members = spark.createDataFrame([("leo", "analyst"), ("ana", "privacy"), ("eva", "guest")], "user string, role string")
    entitled = spark.createDataFrame([("leo", "customer_d", "nation", "3"), ("leo", "customer_d", "nation", "7"), ("leo", "customer_d", "nation", "11"), ("ana", "customer_d", "nation", "3")], "user string, dataset string, column string, value string")
    return protect.governed_views(tables, _described(spark, sf_dir), plan, members, entitled, user, frozenset({"privacy"}))


def _through_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    leo, ana = _views(spark, sf_dir, "leo"), _views(spark, sf_dir, "ana")
    return spark.sql(f"""select 'leo' as reader, c.segment, c.nation, count(distinct c.c_custkey) as customers, max(c.email) as email, max(c.name) as name, count(o.o_orderkey) as orders from {leo['customer_d']} c left join {leo['orders_d']} o on o.custkey = c.c_custkey group by c.segment, c.nation
      union all select 'ana', segment, nation, count(*), max(email), max(name), 0L from {ana['customer_d']} group by segment, nation""")


query("p8_governed_views", CTE + """ select 'leo' as reader, segment, nation, count(distinct c_custkey) as customers, max(case when regexp_matches(email, '^[^@\\s]+@[^@\\s]+$') then regexp_replace(email, '^(.)[^@]*(@.*)$', '\\1***\\2') else '***' end) as email, max(case when name is not null then '***' end) as name, count(o_orderkey) as orders
  from customer_d left join orders_d on custkey = c_custkey where nation in (3, 7, 11) group by segment, nation union all select 'ana', segment, nation, count(*), max(email), max(name), 0 from customer_d where nation = 3 group by segment, nation""")(_through_views)


# --- lineage ---------------------------------------------------------------------------------------------------------------------------

def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events that come after each user's first, as links from event to event, with their distance."""
    e = load(spark, sf_dir, "events").selectExpr("event_id", "lag(event_id) over (partition by user_id order by event_id) as before")
    edges = e.where("before is not null").selectExpr("concat('e', before) as src", "concat('e', event_id) as dst")
    return lineage.closure(edges, e.where("before is null").selectExpr("concat('e', event_id) as start"))


query("l2_event_chains", "select concat('e', first) as start, concat('e', event_id) as node, cast(k - 1 as int) as depth from (select event_id, min(event_id) over (partition by user_id) as first, row_number() over (partition by user_id order by event_id) as k from events) where k > 1")(_chains)
query("l5_first_layer", "with f as (select r_name as s, case when n_nationkey % 2 = 0 then 'zone' else 'region' end as sl, n_name as t, 'nation' as tl, n_nationkey as k from nation join region on n_regionkey = r_regionkey), e as (select s as id, sl as layer, k from f union all select t, tl, k from f) select id, id as label, min_by(layer, k) as layer from e group by id")(
    lambda s, d: lineage.from_flat(load(s, d, "nation").join(load(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("r_name as source", "if(n_nationkey % 2 = 0, 'zone', 'region') as source_layer", "n_name as target", "'nation' as target_layer", "n_nationkey"), "n_nationkey")[0])


# --- contents of bundles ---------------------------------------------------------------------------------------------------------------

def _lines(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(table, line): every row of each table as a text of the columns named."""
    one = lambda df, columns: F.concat_ws("|", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in columns))
    return governance.combined(*(df.select(F.lit(k).alias("table"), one(df, columns).alias("line")) for k, (df, columns) in tables.items()))


def _lines_sql(tables: dict[str, tuple[str, list[str]]]) -> str:
    one = lambda columns: "concat_ws('|', " + ", ".join(f"coalesce(cast(\"{c}\" as varchar), '~')" for c in columns) + ")"
    return " union all ".join(f"select '{k}' as \"table\", {one(columns)} as line from ({sql})" for k, (sql, columns) in tables.items())


_TYPES = "case column_type when 'VARCHAR' then 'string' when 'INTEGER' then 'int' else lower(column_type) end"
_DICTIONARY = "select d.dataset, d.\"column\", t.type, pii, case when length(d.\"column\") > 4 then concat('about ', d.\"column\") end as description from " + described_sql(*DERIVED) + " d join (" + " union all ".join(f"select '{k}' as dataset, column_name as c, {_TYPES} as type from (describe select {', '.join(c)} from {t})" for k, (t, c) in DERIVED.items()) + ") t on t.dataset = d.dataset and t.c = d.\"column\""
_BUNDLE = {
    "catalog": ("g1_catalog", ["dataset", "domain", "description", "owner", "steward", "classification", "source", "refresh", "rows", "columns"]), "dictionary": (None, ["dataset", "column", "type", "pii", "description"]),
    "quality_results": ("q21_rule_evaluation", ["rule_id", "dataset", "column", "dimension", "description", "score", "threshold", "status", "affected_rows"]), "quality_by_dataset": ("f5_by_dataset", ["dataset", "quality"]), "quality_by_dimension": ("f6_by_dimension", ["dimension", "quality"]),
    "lineage": ("j6_labelled_edges", ["source", "source_layer", "target", "target_layer"]), "glossary": ("g2_glossary", ["term_id", "term", "definition", "owner", "linked_datasets"]), "policies": ("g11_policies", ["policy_id", "status", "evidence"]), "kpis": (None, ["kpi", "value"]),
}
_KPIS = RESULTS + "select 'quality_index' as kpi, round_even(avg(score), 2) as value from results union all select kpi, cast(value as double) from (" + SQL["f10_kpis"] + ")"


def _bundle_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine tables written together as JSON and Parquet in turn and read again, row by row."""
    tables, out = _bundle(spark, sf_dir), {}
    for k, fmt in enumerate(("parquet", "json")):
        path, part = scratch_dir(spark), dict(list(tables.items())[k::2])
        files.write_bundle(part, path, fmt)
        out |= {name: (spark.read.schema(df.schema).format(fmt).load(f"{path}/{name}"), _BUNDLE[name][1]) for name, df in part.items()}
    return _lines(out)


query("s15_contents", _lines_sql({k: (SQL[q] if q else {"dictionary": _DICTIONARY, "kpis": _KPIS}[k], c) for k, (q, c) in _BUNDLE.items()}))(_bundle_lines)
_TENANT = {"catalog": ("b3_tenant_catalog", ["dataset", "classification", "tables", "columns", "measures"]), "dictionary": ("b4_tenant_dictionary", ["dataset", "column", "type", "pii", "description"]), "glossary": ("b5_tenant_terms", ["term_id", "dataset", "term", "definition"]),
           "lineage": ("b6_tenant_lineage", ["source", "source_layer", "target", "target_layer"]), "quality": ("q24_model_health", ["rule_id", "dataset", "score", "affected_rows"])}
_SITES = {"catalog": ("b3_site_catalog", ["dataset", "site", "classification", "tables", "columns"]), "dictionary": ("b4_site_dictionary", ["dataset", "column", "type", "pii", "description"]), "glossary": ("b5_site_terms", ["term_id", "dataset", "term", "definition"]),
          "lineage": ("b6_site_lineage", ["source", "source_layer", "target", "target_layer"]), "quality": ("q24_site_health", ["rule_id", "dataset", "score", "affected_rows"])}
for _name, _columns, _made in (("b9_tenant_contents", _TENANT, lambda s, d: bi_models.tenant_governance(_scan(s, d))), ("b9_site_contents", _SITES, lambda s, d: bi_models.site_governance(_site(s, d)))):
    query(_name, _lines_sql({k: (SQL[q], c) for k, (q, c) in _columns.items()}))(lambda s, d, made=_made, columns=_columns: _lines({k: (df, columns[k][1]) for k, df in made(s, d).items()}))
