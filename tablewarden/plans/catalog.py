"""Registered queries over the driver's tables, with the SQL that gives the same rows.

The tables are clean, so defects are derived by key arithmetic, alike in Spark and in SQL.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import bi_models, checks, governance, lineage, mdm, profile, protect, rules, scores
from ..operators.rules import Rule
from ..sources.scratch import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Derived tables: source, and columns as expressions that both engines read alike.
DERIVED = {
    "customer_d": ("customer", ["c_custkey", "case when c_custkey % 37 = 0 then null else c_name end as name", "c_acctbal as balance", "c_nationkey as nation", "c_mktsegment as segment",
                                "case when c_custkey % 41 = 0 then 'ERROR' when c_custkey % 43 = 0 then '-' else concat('', cast(floor(c_acctbal) as bigint)) end as balance_text",
                                "concat('user', c_custkey, case when c_custkey % 19 = 0 then '' else '@example.org' end) as email", "concat('Person ', c_custkey % 700) as full_name"]),
    "orders_d": ("orders", ["o_orderkey", "case when o_orderkey % 97 = 0 then o_custkey + 10000000 else o_custkey end as custkey", "o_orderstatus as status", "case when o_orderkey % 29 = 0 then null else o_orderpriority end as priority",
                            "o_totalprice as total", "cast(o_orderdate as date) as day", "case when o_orderkey % 53 = 0 then 20231399 else cast(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) as bigint) end as ymd",
                            "case when o_orderkey % 31 = 0 then 'UNKNOWN' else concat('', cast(o_orderdate as date)) end as day_text"]),
    "lineitem_d": ("lineitem", ["l_orderkey", "l_linenumber", "l_quantity as quantity", "l_extendedprice as price", "l_quantity * l_extendedprice + case when l_orderkey % 23 = 0 then abs(l_quantity * l_extendedprice) * 0.001 + 1 else 0 end as total",
                                "l_returnflag as flag", "l_linestatus as line_status", "l_discount as discount"]),
    "events_d": ("events", ["event_id", "event_type", "case when event_id % 17 = 0 then null else value end as value", "cast(ts as date) as day", "user_id"]),
}
CTE = "with " + ", ".join(f"{k} as (select {', '.join(c)} from {t})" for k, (t, c) in DERIVED.items())


def pii_sql(column: str) -> str:
    """Whether a column's name tells of personal data, as SQL."""
    parts, whole = "|".join(names.PII_PARTS), "|".join(names.PII_TOKENS)
    plain = f"lower(regexp_replace({column}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'))"
    return f"(regexp_matches(regexp_replace(lower({column}), '[ _.-]+', '', 'g'), '{parts}') or regexp_matches({plain}, '(^|[ _.-])({whole})[0-9]*($|[ _.-])'))"


def described_sql(*tables: str) -> str:
    """(dataset, column, pii) of tables, from DuckDB's own description of them."""
    one = lambda t: f"select '{t}' as dataset, column_name as \"column\" from (describe select {', '.join(DERIVED[t][1]) if t in DERIVED else '*'} from {DERIVED.get(t, (t,))[0]})"
    return f"(select *, {pii_sql(chr(34) + 'column' + chr(34))} as pii from ({' union all '.join(map(one, tables))}))"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f
    return keep


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = DERIVED.get(name, (name, ["*"]))
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*columns)


def all_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {k: load(spark, sf_dir, k) for k in [*DERIVED, "customer", "orders", "lineitem", "documents"]}


#: The rules as data, in the form that rules.compiled() reads.
RULES = rules.compiled(json.loads(Path(__file__).with_name("rule_set.json").read_text()))
#: For each row-level rule the SQL for the rows that count, and for those of them that are bad.
RULE_SQL = {
    "R01": ("true", "not c_acctbal > 0"),
    "R02": ("true", "name is null"),
    "R03": ("true", "coalesce(status not in ('O', 'F'), true)"),
    "R04": ("true", "custkey not in (select c_custkey from customer)"),
    "R05": ("true", r"not regexp_matches(email, '^[a-z0-9]+@[a-z]+\.org$')"),
    "R06": ("true", "date '2024-02-10' - day > 30"),
    "R07": ("true", "trim(balance_text) = '-'"),
    "R08": ("true", "balance_text in ('ERROR', 'UNKNOWN')"),
    "R09": ("true", "day_text = 'UNKNOWN' or try_strptime(day_text, '%Y-%m-%d') is null"),
    "R10": ("true", "try_cast(balance_text as double) is null"),
    "R11": ("status is distinct from 'P'", "priority is null"),
    "R12": ("true", "abs(quantity * price - total) > 0.01 + 1e-5 * abs(total)"),
    "R13": ("flag = 'N'", "line_status is distinct from 'O'"),
    "R14": ("true", "not coalesce(discount between 0.01 and 0.09, false)"),
    "R15": ("event_type in ('purchase', 'click')", "value is null"),
    "R16": ("true", "try_strptime(cast(ymd as varchar), '%Y%m%d') is null"),
    "R17": ("status = 'O'", "not day >= date '1998-01-01'"),
    "R18": ("true", "not regexp_matches(segment, '^[A-M]')"),
    "R19": ("status <> 'P'", "not total > 1000"),
}
#: For each rule over groups the rows that stay when repeats go.
DISTINCT_SQL = {
    "R20": "(select distinct l_orderkey, l_linenumber from lineitem)",
    "R21": "(select distinct text from documents)",
    "R22": "(select distinct * from events_d)",
}


def _counts_sql() -> str:
    head = lambda r: f"select '{r.rule_id}' as rule_id, '{r.dataset}' as dataset, '{r.column}' as \"column\", '{r.dimension}' as dimension, '' as description, cast({r.threshold} as double) as threshold"
    by_row = lambda r, of, bad: f"{head(r)}, count(*) filter (where {of}) as n, count(*) filter (where ({of}) and ({bad})) as bad from {r.dataset}"
    rows = [by_row(r, *RULE_SQL[r.rule_id]) if r.rule_id in RULE_SQL else f"{head(r)}, (select count(*) from {r.dataset}) as n, (select count(*) from {r.dataset}) - count(*) as bad from {DISTINCT_SQL[r.rule_id]}" for r in RULES]
    return " union all ".join(rows)


GRADED = "select *, case when n = 0 then 100.0 else round_even(100.0 * (n - bad) / n, 2) end as score from counted"
RESULTS = CTE + f", counted as ({_counts_sql()}), graded as ({GRADED}), results as (select rule_id, dataset, \"column\", dimension, description, score, threshold, case when score >= threshold then 'pass' when score >= threshold - 2 then 'warn' else 'fail' end as status, cast(bad as bigint) as affected_rows from graded) "


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.evaluate_rules(spark, RULES, all_tables(spark, sf_dir))


query("q21_rule_evaluation", RESULTS + "select * from results")(results)
for _r in RULES:
    if _r.rule_id != "R20":  # R21 is of its kind too
        query(f"q_{_r.kind}", RESULTS + f"select * from results where rule_id = '{_r.rule_id}'")(lambda s, d, r=_r: rules.evaluate_rules(s, [r], all_tables(s, d)))


@query("q23_rule_table", RESULTS + "select * from results")
def from_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules written as a table of rule rows, read back from it and evaluated."""
    table = written(rules.rule_table(spark, RULES))
    return rules.evaluate_rules(spark, rules.rules_from_table(table), all_tables(spark, sf_dir))


def _rows_sql(rows: list[dict], counted: dict[str, str]) -> str:
    """Results of rule rows whose n and bad come from SQL."""
    head = lambda r: f"select '{r['rule_id']}' as rule_id, '{r['dataset']}' as dataset, '{r['column']}' as \"column\", '{r['dimension']}' as dimension, '' as description, cast({r['threshold']} as double) as threshold"
    union = " union all ".join(f"{head(r)}, n, bad from ({counted[r['rule_id']]})" for r in rows)
    return CTE + f", counted as ({union}), graded as ({GRADED}) select rule_id, dataset, \"column\", dimension, description, score, threshold, case when score >= threshold then 'pass' when score >= threshold - 2 then 'warn' else 'fail' end as status, cast(bad as bigint) as affected_rows from graded"


#: Rules with measures of a joined table: of another by key, of the own by group, of the own as a whole.
LOOKUPS = [
    {"rule_id": "R23", "dataset": "orders_d", "column": "total", "dimension": "consistency", "kind": "lookup", "threshold": 60.0,
     "params": {"table": "lineitem_d", "on": '{"o_orderkey": "l_orderkey"}', "measure": '{"lines": "count(*)", "goods": "max(price)"}', "of": "status <> 'P'", "passes": "lines >= 3 and goods > 1000"}},
    {"rule_id": "R24", "dataset": "orders_d", "column": "total", "dimension": "accuracy", "kind": "lookup", "threshold": 95.0,
     "params": {"on": '{"status": "status"}', "measure": '{"middle": "avg(total)", "spread": "stddev_pop(total)"}', "passes": "abs(total - middle) <= 1.5 * spread"}},
    {"rule_id": "R25", "dataset": "events_d", "column": "day", "dimension": "timeliness", "kind": "lookup", "threshold": 50.0, "params": {"measure": '{"last": "max(day)"}', "passes": "datediff(last, day) <= 10"}},
]
_LOOKED_UP = _rows_sql(LOOKUPS, {
    "R23": "select count(*) filter (where status <> 'P') as n, count(*) filter (where status <> 'P' and not coalesce(lines >= 3 and goods > 1000, false)) as bad from orders_d left join (select l_orderkey, count(*) as lines, max(price) as goods from lineitem_d group by 1) on o_orderkey = l_orderkey",
    "R24": "select count(*) as n, count(*) filter (where not coalesce(abs(total - middle) <= 1.5 * spread, false)) as bad from orders_d left join (select status, avg(total) as middle, stddev_pop(total) as spread from orders_d group by 1) using (status)",
    "R25": "select count(*) as n, count(*) filter (where not coalesce((select max(day) from events_d) - day <= 10, false)) as bad from events_d"})
query("q_lookup", _LOOKED_UP)(lambda s, d: rules.evaluate_rules(s, rules.compiled(LOOKUPS), all_tables(s, d)))

#: Checks over batches that rules name.
CHECKS = {"digit": checks.CheckDigit("event_id"), "gaps": checks.GapCheck("day"), "short": checks.FrameCheck(["event_type", "value"], lambda f: (int((f.event_type == "click").sum()), int(((f.event_type == "click") & ~(f.value > 10)).sum())))}
BATCHED = [{"rule_id": f"R{26 + k}", "dataset": "events_d", "column": c, "dimension": dimension, "kind": "aggregate", "threshold": t, "params": {"check": name}} for k, (name, c, dimension, t) in enumerate((("digit", "event_id", "validity", 5.0), ("gaps", "day", "timeliness", 90.0), ("short", "value", "accuracy", 80.0)))]
_BATCHED = _rows_sql(BATCHED, {
    "R26": "select count(*) as n, count(*) filter (where list_sum(list_transform(range(1, length(t) + 1), lambda i: case when i % 2 = 0 then (2 * cast(t[i] as int)) % 10 + (2 * cast(t[i] as int)) // 10 else cast(t[i] as int) end)) % 10 <> 0) as bad from (select reverse(cast(event_id as varchar)) as t from events_d)",
    "R27": "select max(day) - min(day) + 1 as n, max(day) - min(day) + 1 - count(distinct day) as bad from events_d",
    "R28": "select count(*) as n, count(*) filter (where not coalesce(value > 10, false)) as bad from events_d where event_type = 'click'"})
query("q_aggregate", _BATCHED)(lambda s, d: rules.evaluate_rules(s, rules.compiled(BATCHED, CHECKS), all_tables(s, d)))


@query("q22_auto_rules", CTE + """, c as (select 1 as k, 'value' as col, count(*) as n, count(*) - count(value) as bad from events_d union all select 0, 'event_id', count(*), count(*) - count(distinct event_id) from events_d
  union all select 2, '*', count(*), count(*) - (select count(*) from (select distinct * from events_d)) from events_d)
  select concat('AUTO-0', cast(k + 1 as varchar)) as rule_id, col as "column", round_even(100.0 * (n - bad) / n, 2) as score, cast(bad as bigint) as affected_rows from c""")
def auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules proposed from the profile of events, evaluated."""
    df = load(spark, sf_dir, "events_d")
    rows = profile.profile_table(df, "event_id").collect()  # one row per column
    found = rules.auto_rules(rows, df.count(), True, "events_d")
    return rules.evaluate_rules(spark, found, {"events_d": df}).select("rule_id", "column", "score", "affected_rows")


def _over(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    query(name, RESULTS + sql)(lambda s, d: f(results(s, d)))


_over("p5_open_issues", lambda r: scores.open_issues(r).select("rule_id", "severity"), "select rule_id, case when status = 'warn' then 'media' else 'alta' end as severity from results where status <> 'pass'")
_over("f5_by_dataset", scores.by_dataset, "select dataset, round_even(avg(score), 2) as quality from results group by dataset")
_over("f6_by_dimension", scores.by_dimension, "select dimension, round_even(avg(score), 2) as quality from results group by dimension")
_over("f7_matrix", scores.matrix, "select dataset, " + ", ".join(f"round_even(avg(score) filter (where dimension = '{d}'), 2) as {d}" for d in rules.DIMENSIONS) + " from results group by dataset")
_over("f8_overall", scores.overall, "select round_even(avg(score), 2) as quality_index from results")
_over("f10_kpis", scores.kpis, "select 'rules_total' as kpi, count(*) as value from results union all select concat('rules_', s), count(*) filter (where status = s) from results, (values ('pass'), ('warn'), ('fail')) v(s) group by s")
_over("f12_run_summary", scores.run_summary, "select round_even(avg(score), 2) as quality_index, count(*) filter (where status = 'pass') as ok, count(*) as total, count(*) filter (where status = 'fail') as fails, count(*) filter (where status <> 'pass') as alerts, cast(sum(affected_rows) as bigint) as affected_rows from results")
_over("p4_equality_filters", lambda r: protect.equal(r, status="fail", dataset=None).select("rule_id", "dataset"), "select rule_id, dataset from results where status = 'fail'")
_over("p7_labels", lambda r: protect.labelled_codes(r, "status", {"pass": "ok", "warn": "at risk", "fail": "broken"}).select("rule_id", "status_label"), "select rule_id, case status when 'pass' then 'ok' when 'warn' then 'at risk' else 'broken' end as status_label from results")
_over("p2_row_search", lambda r: protect.search_rows(r, "EVENTS_d").select("rule_id"), "select rule_id from results where dataset = 'events_d'")

BEFORE, AFTER = Rule("B1", "orders_d", "priority", "completeness", "not_null"), Rule("B1", "orders", "o_orderpriority", "completeness", "not_null")


@query("f13_impact", CTE + """, b as (select round_even(100.0 * count(priority) / count(*), 2) as i, count(*) - count(priority) as r from orders_d), a as (select round_even(100.0 * count(o_orderpriority) / count(*), 2) as i, count(*) - count(o_orderpriority) as r from orders)
  select b.i as index_before, cast(b.r as bigint) as rows_before, a.i as index_after, cast(a.r as bigint) as rows_after, round_even(a.i - b.i, 1) as index_gain, case when b.r = 0 then 0.0 else round_even(100.0 * (b.r - a.r) / b.r, 1) end as reduction_pct from a, b""")
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = all_tables(spark, sf_dir)
    return scores.impact(rules.evaluate_rules(spark, [BEFORE], t), rules.evaluate_rules(spark, [AFTER], t))


@query("f9_trend", CTE + ", d as (select day, 100.0 * count(priority) / count(*) as q from orders_d group by day) select cast(date_trunc('month', day) as timestamp) as month, round_even(max_by(q, day), 2) as quality_index from d group by 1")
def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's completeness is a stored run; the month shows its last."""
    runs = load(spark, sf_dir, "orders_d").groupBy("day").agg((100.0 * F.count("priority") / F.count("*")).alias("score")).withColumnRenamed("day", "run_ts")
    return scores.trend(runs).select(F.col("month").cast("timestamp_ntz").alias("month"), "quality_index")


def _profile_sql(table: str, order: str, columns: list[tuple[str, str, bool]]) -> str:
    one = "select '{c}' as \"column\", '{t}' as dtype, round_even(100.0 * (count(*) - count({c})) / count(*), 2) as null_pct, count(distinct {c}) as unique_values, coalesce(min_by(substr(cast({c} as varchar), 1, 40), {o}) filter (where {c} is not null), '') as sample, {p} as possible_pii from {d}"
    return CTE + " " + " union all ".join(one.format(c=c, t=t, o=order, d=table, p=str(p).lower()) for c, t, p in columns)


@query("f1_profile", _profile_sql("customer_d", "c_custkey", [("c_custkey", "bigint", False), ("name", "string", True), ("balance", "double", False), ("nation", "int", False), ("segment", "string", False), ("balance_text", "string", False), ("email", "string", True), ("full_name", "string", True)]))
def profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_table(load(spark, sf_dir, "customer_d"), "c_custkey")


@query("f1_profile_events", _profile_sql("events", "event_id", [("event_id", "bigint", False), ("ts", "timestamp_ntz", False), ("user_id", "bigint", False), ("event_type", "string", False), ("value", "double", False), ("props", "string", False)]))
def profiled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_table(load(spark, sf_dir, "events"), "event_id")


@query("f2_summary", CTE + " select count(*) as rows, cast(8 as bigint) as columns, cast(count(*) - (select count(*) from (select distinct * from customer_d)) as bigint) as duplicate_rows, round_even(100.0 * (count(*) - count(name)) / (count(*) * 8), 2) as null_cell_pct, (select count(*) from " + described_sql("customer_d") + " where pii) as pii_columns from customer_d")
def summarized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.summary(load(spark, sf_dir, "customer_d"))


def _suggestions_sql(columns: list[str]) -> str:
    of = "select '{k}' as suggestion, '{c}' as \"column\" from customer_d having {h}"
    rules = {"not_null": "count(*) - count({c}) between 1 and count(*) * 0.2", "unique": "count(*) > 1 and count({c}) = count(*) and count(distinct {c}) = count(*)"}
    rows = [of.format(k=k, c=c, h=h.format(c=c)) for c in columns for k, h in rules.items()]
    return CTE + " " + " union all ".join(rows) + " union all select 'protect', \"column\" from " + described_sql("customer_d") + " where pii"


@query("f3_suggestions", _suggestions_sql(["c_custkey", "name", "balance", "nation", "segment", "balance_text", "email", "full_name"]))
def suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "customer_d")
    p = profile.profile_table(df, "c_custkey")
    return profile.suggestions(p, df.count(), 0)


@query("f16_blocking_columns", CTE + " select * from (select 'nation' as \"column\", count(distinct nation) as unique_values from customer_d union all select 'segment', count(distinct segment) from customer_d) where unique_values between 2 and 30")
def blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.blocking_columns(profile.profile_table(load(spark, sf_dir, "customer_d"), "c_custkey"))


MATCHES = [mdm.Match("s_name", 1.0, "fuzzy", 0.85), mdm.Match("s_acctbal", 1.5)]
_RATIO = "1 - levenshtein(lower(trim(a.{c})), lower(trim(b.{c}))) / greatest(length(trim(a.{c})), length(trim(b.{c})))"


@query("m3_scored_pairs", f"""with p as (select a.s_suppkey as a, b.s_suppkey as b, {_RATIO.format(c='s_name')} as r, a.s_acctbal = b.s_acctbal as e from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey)
  select a, b, ((case when r >= 0.85 then r else 0 end) + (case when e then 1.5 else 0 end)) / 2.5 as score from p""")
def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "supplier")
    return mdm.block_scores(df, "s_suppkey", "s_nationkey", MATCHES, named=False)


PEOPLE = [mdm.Match("full_name", 1.0), mdm.Match("segment", 1.0)]
_LINKS = CTE + """, links as (select a.c_custkey as a, b.c_custkey as b, ((case when a.full_name = b.full_name then 1 else 0 end) + (case when a.segment = b.segment then 1 else 0 end)) / 2.0 as score from customer_d a join customer_d b on a.full_name = b.full_name and a.nation % 5 = b.nation % 5 and a.c_custkey < b.c_custkey),
  kept as (select * from links where score >= 0.9), two_ways as (select a, b from kept union select b, a from kept), members as (select a as node, least(a, min(b)) as component from two_ways group by a) """


def _people(spark: SparkSession, sf_dir: str):
    df = load(spark, sf_dir, "customer_d").withColumn("block", F.concat_ws("|", "full_name", (F.col("nation") % 5).cast("string")))
    return df, *mdm.clustered(df, "c_custkey", "block", PEOPLE, 0.9)


@query("m4_clusters", _LINKS + "select component, count(*) as rows, 1.0 as confidence from members group by component")
def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir)[2].select("component", "rows", "confidence")


@query("m5_golden_records", _LINKS + ", r as (select m.component, d.c_custkey, d.name, d.segment, (case when d.name is null then 0 else 1 end) as f from members m join customer_d d on d.c_custkey = m.node), g as (select component, max(f) as top from r group by component) select r.component, min(r.c_custkey) filter (where f = top) as c_custkey, min_by(name, r.c_custkey) filter (where f = top) as name, min(segment) as segment from r join g on r.component = g.component group by r.component")
def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, members, _ = _people(spark, sf_dir)
    return mdm.golden_records(df.select("c_custkey", "name", "segment"), "c_custkey", members)


@query("m6_dedup_report", _LINKS + ", c as (select component, count(*) as rows, list_sort(list(node)) as ids from members group by component), k as (select *, row_number() over (order by component) as k from c) select concat('DUP-', lpad(cast(k as varchar), cast(greatest(3, length(cast(k as varchar))) as int), '0')) as cluster_id, rows, 100.0 as confidence, 'full_name, segment' as matched_on, array_to_string(ids, ',') as row_indices from k")
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, members, found = _people(spark, sf_dir)
    return mdm.dedup_report(members, found).withColumn("row_indices", F.array_join("row_indices", ","))


_GRAPH = """with recursive edges as (select concat('R', r_regionkey) as src, concat('N', n_nationkey) as dst from nation join region on n_regionkey = r_regionkey union all select concat('N', s_nationkey), concat('S', s_suppkey) from supplier),
  down as (select src as start, dst as node, 1 as depth from edges union select d.start, e.dst, d.depth + 1 from down d join edges e on e.src = d.node) """


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = load(spark, sf_dir, "nation"), load(spark, sf_dir, "supplier")
    return n.selectExpr("concat('R', n_regionkey) as src", "concat('N', n_nationkey) as dst").unionByName(s.selectExpr("concat('N', s_nationkey) as src", "concat('S', s_suppkey) as dst"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t, key, label, layer: load(spark, sf_dir, t).selectExpr(f"concat('{layer[0].upper()}', {key}) as id", f"{label} as label", f"'{layer}' as layer")
    return one("region", "r_regionkey", "r_name", "region").unionByName(one("nation", "n_nationkey", "n_name", "nation")).unionByName(one("supplier", "s_suppkey", "s_name", "supplier"))


_NODES = ", nodes as (select concat('R', r_regionkey) as id, r_name as label, 'region' as layer from region union all select concat('N', n_nationkey), n_name, 'nation' from nation union all select concat('S', s_suppkey), s_name, 'supplier' from supplier) "
query("l1_upstream", _GRAPH + "select start as node, cast(min(depth) as int) as depth from down where node = 'S7' group by start")(lambda s, d: lineage.upstream(_edges(s, d), "S7"))
query("l2_downstream", _GRAPH + "select node, cast(min(depth) as int) as depth from down where start = 'R1' group by node")(lambda s, d: lineage.downstream(_edges(s, d), "R1"))
query("l2_closure", _GRAPH + "select start, node, cast(min(depth) as int) as depth from down group by start, node")(lambda s, d: lineage.closure(_edges(s, d)))
query("l3_consumers", _GRAPH + _NODES + "select start, array_to_string(list(label order by depth, label), '|') as consumers from (select d.start, n.label, min(d.depth) as depth, d.node from down d join nodes n on n.id = d.node join nodes r on r.id = d.start and r.layer = 'region' group by d.start, d.node, n.label) group by start")(
    lambda s, d: lineage.consumers(_nodes(s, d), _edges(s, d), "region").withColumn("consumers", F.array_join("consumers", "|")))
query("l4_focus", _GRAPH + ", i as (select 'N5' as node union select start from down where node = 'N5' union select node from down where start = 'N5') select src, dst from edges where src in (select node from i) and dst in (select node from i)")(lambda s, d: lineage.focus(_edges(s, d), "N5"))
query("j6_labelled_edges", _GRAPH + _NODES + "select a.label as source, a.layer as source_layer, b.label as target, b.layer as target_layer from edges join nodes a on a.id = src join nodes b on b.id = dst")(lambda s, d: lineage.labelled(_nodes(s, d), _edges(s, d)))
query("l5_flat_nodes", _GRAPH + _NODES + "select label as id, label, min(layer) as layer from nodes where id in (select src from edges union select dst from edges) group by label")(lambda s, d: lineage.from_flat(lineage.labelled(_nodes(s, d), _edges(s, d)))[0])
query("l6_extended", _GRAPH + "select src, dst from edges union select concat('ext', n_nationkey), concat('N', n_nationkey) from nation union select concat('N', n_nationkey), concat('report', n_regionkey) from nation")(
    lambda s, d: lineage.extended(_edges(s, d), load(s, d, "nation").selectExpr("concat('ext', n_nationkey) as source", "concat('N', n_nationkey) as dataset", "concat('report', n_regionkey) as report")))

#: (dataset, domain en, domain es, owner, steward, classification, source, refresh)
DATASETS = [("customer_d", "Sales", "Ventas", "Ana Ruiz", "Leo Paz", "PII", "crm", "daily"), ("orders_d", "Sales", None, "Ana Ruiz", "Data team", "internal", "erp", "hourly"), ("lineitem_d", "Logistics", None, "", "Mia Sol", "", "erp", "hourly"), ("events_d", "Web", "Web", "Team web", "Mia Sol", "internal", "web", "live")]
_DATASETS = "datasets as (select * from (values " + ", ".join("('{}', '{}', '{}', '{}', '{}', '{}', '{}')".format(d[0], *d[1:2], *d[3:]) for d in DATASETS) + ") v(dataset, domain, owner, steward, classification, source, refresh)) "


def _datasets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d, {"en": en} | ({"es": es} if es else {}), {"es": f"tabla {d}"}, *rest) for d, en, es, *rest in DATASETS], "dataset string, domain map<string,string>, description map<string,string>, owner string, steward string, classification string, source string, refresh string")


query("g1_catalog", CTE + ", " + _DATASETS + ", n as (select 'customer_d' as dataset, count(*) as rows, cast(8 as bigint) as columns from customer_d union all select 'orders_d', count(*), 8 from orders_d union all select 'lineitem_d', count(*), 8 from lineitem_d union all select 'events_d', count(*), 5 from events_d) select dataset, domain, concat('tabla ', dataset) as description, owner, steward, classification, source, refresh, rows, columns from datasets join n using (dataset)")(
    lambda s, d: governance.catalog(_datasets(s), {k: load(s, d, k) for k in DERIVED}))
query("g12_compliance", RESULTS + ", " + _DATASETS + ", c as (select d.dataset, count(rule_id) as rules, count(*) filter (where status = 'pass') as passed, count(*) filter (where status = 'warn') as w, count(*) filter (where status = 'fail') as f from datasets d left join results r on r.dataset = d.dataset group by d.dataset) select dataset, rules, passed, case when rules = 0 then 100.0 else round_even(100.0 * passed / rules, 1) end as pct_pass, case when f > 0 then 'incumple' when w > 0 then 'en_riesgo' else 'cumple' end as compliance from c")(
    lambda s, d: governance.compliance(_datasets(s), results(s, d)))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").selectExpr("concat('I', p_partkey) as item_id", "case when p_partkey % 2 = 0 then 'customer_d' when p_partkey % 3 = 0 then 'orders_d' else 'events_d' end as dataset", "p_name as text")


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").where("p_partkey % 5 = 0").selectExpr("concat('I', p_partkey) as item_id", "case when p_partkey % 2 = 0 then 'en' else 'es' end as lang", "case when p_partkey % 3 = 0 then 'modificado' else 'validado' end as status", "case when p_partkey % 9 = 0 then '' else p_brand end as text", "'Leo Paz' as responsible")


_CURATED = "curated as (select concat('I', p_partkey) as item_id, case when p_partkey % 2 = 0 then 'customer_d' when p_partkey % 3 = 0 then 'orders_d' else 'events_d' end as dataset, case when p_partkey % 10 <> 0 then 'sugerido_ia' when p_partkey % 3 = 0 then 'modificado' else 'validado' end as status, case when p_partkey % 30 = 0 and p_partkey % 9 <> 0 then p_brand else p_name end as text, case when p_partkey % 10 = 0 then 'Leo Paz' end as responsible from part) "
query("g5_curation", "with " + _CURATED + "select * from curated")(lambda s, d: governance.curation(_items(s, d), _verdicts(s, d), "en"))
query("f14_curation_progress", "with " + _CURATED + "select dataset, count(*) as items, count(*) filter (where status <> 'sugerido_ia') as reviewed, round_even(100.0 * count(*) filter (where status <> 'sugerido_ia') / count(*), 1) as reviewed_pct from curated group by dataset")(
    lambda s, d: governance.curation_progress(governance.curation(_items(s, d), _verdicts(s, d), "en"), ["dataset"]))
query("g6_validate_pending", "with " + _CURATED + "select item_id, 'en' as lang, 'validado' as status, '' as text, 'Mia Sol' as responsible from curated where dataset = 'orders_d' and status = 'sugerido_ia'")(
    lambda s, d: governance.validate_pending(governance.curation(_items(s, d), _verdicts(s, d), "en"), "orders_d", "Mia Sol", "en"))
query("g4_upsert", "select o_custkey as custkey, max_by(o_totalprice, o_orderkey) as total, max(o_orderkey) as stamp from orders group by o_custkey")(
    lambda s, d: governance.merged(load(s, d, "orders").where("o_orderkey % 2 = 0").selectExpr("o_custkey as custkey", "o_totalprice as total", "o_orderkey as stamp"), load(s, d, "orders").where("o_orderkey % 2 = 1").selectExpr("o_custkey as custkey", "o_totalprice as total", "o_orderkey as stamp"), ["custkey"], "stamp"))


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _datasets(spark)
    items = governance.curation(_items(spark, sf_dir), _verdicts(spark, sf_dir), "en").withColumn("linked_datasets", F.array("dataset"))
    return governance.coverage(base.select("dataset", "classification"), base.select("dataset", "owner", "steward"), results(spark, sf_dir), items)


_NAMED = "({c} is not null and trim({c}) <> '' and not regexp_matches(lower(trim({c})), '^(" + "|".join(names.TEAM_WORDS) + ")'))"
_COVERED = RESULTS + ", " + _DATASETS + ", " + _CURATED + ", p as (select dataset, round_even(100.0 * count(*) filter (where status <> 'sugerido_ia') / count(*), 1) as pct from curated group by dataset), covered as (select d.dataset, " + "(" + _NAMED.format(c="owner") + " or " + _NAMED.format(c="steward") + ") as owner_named, " + _NAMED.format(c="steward") + " as steward_named, trim(classification) <> '' as classified, d.dataset in (select dataset from results) as has_rules, coalesce(pct, 0.0) as curation_pct from datasets d left join p on p.dataset = d.dataset) "
query("g9_coverage", _COVERED + "select * from covered")(_covered)
query("g10_governance_index", _COVERED + ", w as (select " + ", ".join(f"round_even(100.0 * avg(cast({c} as int)), 1) as {c}" for c in ("owner_named", "steward_named", "classified", "has_rules")) + ", round_even(avg(curation_pct), 1) as curation_pct from covered) select *, round_even((owner_named + steward_named + classified + has_rules + curation_pct) / 5, 1) as governance_index from w")(lambda s, d: governance.governance_index(_covered(s, d)))


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.dictionary({k: load(spark, sf_dir, k) for k in DERIVED}).withColumn("pii", names.pii_name(F.col("column"))).withColumn("description", F.when(F.length("column") > 4, F.concat(F.lit("about "), "column")))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "region").selectExpr("concat('T', r_regionkey) as term_id", "map('es', r_name) as term", "map('en', concat('All of ', r_name), 'es', 'x') as definition", "'Ana Ruiz' as owner", "case when r_regionkey = 0 then array() else array('customer_d', 'orders_d') end as linked_datasets")


query("g2_glossary", "select concat('T', r_regionkey) as term_id, r_name as term, concat('All of ', r_name) as definition, 'Ana Ruiz' as owner, case when r_regionkey = 0 then '' else 'customer_d, orders_d' end as linked_datasets from region")(lambda s, d: governance.glossary(_terms(s, d)))


def _remedies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("dimension", k, f"look into {k}") for k in ("completeness", "validity", "uniqueness")] + [("rule", "R04", "load the missing customers")], "scope string, key string, action string")


_ACTION = "case when rule_id = 'R04' then 'load the missing customers' when dimension in ('completeness', 'validity', 'uniqueness') then concat('look into ', dimension) else 'look into completeness' end as action"
_over("g17_findings", lambda r: governance.with_remedy(scores.open_issues(r), _remedies(r.sparkSession)).select("rule_id", "severity", "action"), f"select rule_id, case when status = 'warn' then 'media' else 'alta' end as severity, {_ACTION} from results where status <> 'pass'")


def _feeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("customer_d", ["Sales board", "Churn"]), ("orders_d", ["Sales board"])], "start string, consumers array<string>")


query("g14_alerts", RESULTS + ", " + _DATASETS + f"select rule_id, r.dataset, case when status = 'warn' then 'media' else 'alta' end as severity, case when status = 'warn' then steward else concat(owner, ', ', steward) end as notify, case r.dataset when 'customer_d' then 'Sales board, Churn' when 'orders_d' then 'Sales board' else '—' end as impact, {_ACTION}, affected_rows from results r join datasets d on d.dataset = r.dataset where status <> 'pass'")(
    lambda s, d: governance.alerts(results(s, d), _datasets(s), _feeds(s), _remedies(s)))


query("p8_masking", CTE + " select c_custkey, case when name is not null then '***' end as name, case when regexp_matches(email, '^[^@\\s]+@[^@\\s]+$') then regexp_replace(email, '^(.)[^@]*(@.*)$', '\\1***\\2') when email is not null then '***' end as email, segment from customer_d")(
    lambda s, d: protect.masked(load(s, d, "customer_d"), _described(s, d), "customer_d").select("c_custkey", "name", "email", "segment"))
query("p9_row_policy", CTE + " select c_custkey, segment from customer_d where nation in (3, 7)")(
    lambda s, d: protect.entitled(load(s, d, "customer_d"), "nation", s.createDataFrame([("leo", 3), ("leo", 7), ("ana", 1)], "user string, value int"), "leo").select("c_custkey", "segment"))
query("p3_metadata_search", "select 'part' as kind, p_name as item from part where contains(lower(p_name), '1') and contains(lower(p_name), '12') union all select 'nation', n_name from nation where contains(lower(n_name), '12')")(
    lambda s, d: protect.search_tables({"part": (load(s, d, "part"), ["p_name"], "p_name"), "nation": (load(s, d, "nation"), ["n_name"], "n_name")}, "12"))
query("p11_preview", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")(
    lambda s, d: protect.preview(load(s, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 20))


def tenant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenant scan put together from the driver's tables, a row per workspace: a model per region, a table per nation, its suppliers as measures."""
    s = load(spark, sf_dir, "supplier").selectExpr("s_nationkey", "named_struct('name', s_name, 'expression', concat('SUM ( Sales[S', s_suppkey % 4, '] )'), 'description', case when s_suppkey % 3 = 0 then 'known' end) as m")
    m = s.groupBy("s_nationkey").agg(F.collect_list("m").alias("measures"))
    t = load(spark, sf_dir, "nation").join(m, F.col("n_nationkey") == F.col("s_nationkey"), "left").selectExpr("n_regionkey", "named_struct('name', n_name, 'columns', array(named_struct('name', 'S1', 'dataType', 'Int64', 'description', string(null), 'expression', string(null)), named_struct('name', 'email', 'dataType', 'String', 'description', 'e-mail', 'expression', '1')), 'measures', measures, 'source', array(named_struct('expression', 'Source = Sql.Database(\"srv\", \"db\")'))) as t")
    d = t.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct(F.col("t.name").alias("name"), F.col("t").alias("t")))).alias("ts")).join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    w = d.selectExpr("named_struct('name', concat('ws ', r_name), 'datasets', array(named_struct('id', concat('d', r_regionkey), 'name', r_name, 'tables', transform(ts, x -> x.t), 'relationships', cast(array() as array<struct<fromTable:string,fromColumn:string,toTable:string,toColumn:string,crossFilteringBehavior:string>>), 'roles', case when r_regionkey % 2 = 0 then array(named_struct('name', 'reader')) else cast(array() as array<struct<name:string>>) end)), 'reports', array(named_struct('name', concat('report ', r_name), 'datasetId', string(null)))) as w")
    return w.select(F.array("w").alias("workspaces"))


def _scan(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return bi_models.tenant_tables(tenant_scan(spark, sf_dir))


query("b1_tenant_columns", "select concat('d', n_regionkey) as dataset_id, r_name as model, n_name as \"table\", c as \"column\" from nation join region on r_regionkey = n_regionkey, (values ('S1'), ('email')) v(c)")(lambda s, d: _scan(s, d)["columns"].select("dataset_id", "model", "table", "column"))
query("b3_tenant_catalog", "select r_name as dataset, 'PII' as classification, count(distinct n_name) as tables, cast(count(distinct n_name) * 2 as bigint) as columns, (select count(*) from supplier join nation n2 on s_nationkey = n2.n_nationkey where n2.n_regionkey = r_regionkey) as measures from region join nation on n_regionkey = r_regionkey group by r_name, r_regionkey")(lambda s, d: bi_models.tenant_catalog(_scan(s, d)))
query("b6_tenant_lineage", "select 'srv/db' as source, 'source' as source_layer, n_name as target, 'table' as target_layer from nation union select n_name, 'table', r_name, 'model' from nation join region on r_regionkey = n_regionkey union select r_name, 'model', concat('report ', r_name), 'report' from region where r_regionkey in (select n_regionkey from nation)")(lambda s, d: bi_models.tenant_lineage(_scan(s, d)))
query("b7_sources", "select distinct r_name as model, 'srv/db' as sources from nation join region on r_regionkey = n_regionkey")(lambda s, d: bi_models.sources_text(_scan(s, d)))
_HEALTH = """with per as (select r_regionkey as k, r_name as model, count(*) as nations from region join nation on n_regionkey = r_regionkey group by 1, 2),
  ms as (select n_regionkey as k, count(*) as n, count(*) filter (where s_suppkey % 3 = 0) as doc, count(*) - count(distinct s_suppkey % 4) as rep, count(*) filter (where s_suppkey % 4 = 1) > 0 as s1 from supplier join nation on s_nationkey = n_nationkey group by 1),
  j as (select k, model, nations, greatest(coalesce(n, 0), 1) as n, coalesce(doc, 0) as doc, coalesce(rep, 0) as rep, nations + case when coalesce(s1, false) then 0 else nations end as orphans from per left join ms using (k)),
  c as (select 'PBI-01' as rule_id, model as dataset, doc as good, n, n - doc as bad from j union all select 'PBI-02', model, n - rep, n, rep from j union all select 'PBI-03', model, 1 - k % 2, 1, k % 2 from j
  union all select 'PBI-04', model, 2 * nations - orphans, 2 * nations, orphans from j union all select 'PBI-05', model, nations, 2 * nations, nations from j)
  select rule_id, dataset, round_even(100.0 * good / n, 1) as score, cast(bad as bigint) as affected_rows from c"""
for _name in ("q24_model_health", "q24_all_rules"):
    query(_name, _HEALTH)(lambda s, d: bi_models.tenant_health(_scan(s, d)).select("rule_id", "dataset", "score", "affected_rows"))
