"""Declarative data-quality rules, all row-level rules of a dataset fused into one aggregate.

A rule names a kind and its parameters. A row-level kind compiles to two predicates: which
rows count, and which of them are bad. Foreign keys and lookups join in; uniqueness and
whole-row duplicates need a grouping of their own. Checks of one's own over Arrow batches share
one pass over their dataset, their states are merged per rule. Scores are 100 * (n - bad) / n, and
100 when no row counts.

Rules can come as rows (rule_id, dataset, column, dimension, kind, params, threshold, description),
with params as a map of texts; see compiled().
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS = ["completeness", "uniqueness", "validity", "consistency", "timeliness", "accuracy"]
RESULT_COLUMNS = ["rule_id", "dataset", "column", "dimension", "description", "score", "threshold", "status", "affected_rows"]
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    dataset: str
    column: str
    dimension: str
    kind: str
    params: dict = field(default_factory=dict)
    threshold: float = 95.0
    description: dict[str, str] = field(default_factory=dict)


def _mark(rule: Rule) -> str:
    """The rule's id, whatever its letters, as part of a column name."""
    return rule.rule_id.encode().hex()


def number(c: Column, kind: str) -> Column:
    """A value as double; text only where it is plainly a number."""
    return F.when(c.rlike(NUMBER), c.try_cast("double")) if kind == "string" else c.cast("double")


def parsed_date(c: Column, kind: str, formats: list[str] | None = None) -> Column:
    if kind != "string":
        return c.cast("date")
    return F.coalesce(*(F.try_to_date(c, f) for f in formats or ["yyyy-MM-dd"]))


def age_days(c: Column, kind: str, as_of: str) -> Column:
    if kind.startswith("timestamp"):
        return F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(c.cast("timestamp"))) / 86400)
    return F.datediff(F.lit(as_of).cast("date"), parsed_date(c, kind))


def _bad(test: Column) -> Column:
    """Rows that do not pass; an unknown outcome does not."""
    return ~F.coalesce(test, F.lit(False))


def predicate(rule: Rule, kinds: dict[str, str]) -> tuple[Column, Column]:
    """(which rows count, which of those are bad) of a row-level rule over a table with these column types."""
    p, all_rows = rule.params, F.lit(True)
    c, t = F.col(f"`{rule.column}`"), kinds.get(rule.column, "string")
    other = lambda name: F.col(f"`{p[name]}`")
    text = c.cast("string")
    match rule.kind:
        case "not_null":
            return all_rows, c.isNull()
        case "regex" | "matches_pattern":
            return all_rows, _bad(text.rlike(f"(?U)^(?:{p['pattern']})"))
        case "positive":
            return all_rows, _bad(number(c, t) > 0)
        case "in_set":
            return all_rows, _bad(c.isin(*p["values"]))
        case "max_age":
            return all_rows, _bad(age_days(c, t, p["as_of"]) <= p["days"])
        case "fk":
            return all_rows, F.col(f"_fk_{_mark(rule)}").isNull()
        case "not_placeholder":
            return all_rows, c.isNull() | F.trim(text).isin(*p.get("values", ["-"]))
        case "not_marker":
            return all_rows, c.isNull() | text.isin(*p.get("values", ["ERROR", "UNKNOWN"]))
        case "valid_date":
            marker = text.isin(*p.get("markers", ["ERROR", "UNKNOWN"]))
            return all_rows, _bad(~marker & parsed_date(c, t, p.get("formats")).isNotNull())
        case "numeric":
            marker = text.isin(*p.get("markers", ["ERROR", "UNKNOWN"]))
            return all_rows, _bad(~marker & number(c, t).isNotNull())
        case "completeness_unless":
            return ~c.eqNullSafe(F.lit(p["value"])), other("then").isNull()
        case "amount":
            q, price, total = (number(F.col(f"`{p[k]}`"), kinds[p[k]]) for k in ("quantity", "price", "total"))
            return q.isNotNull() & price.isNotNull() & total.isNotNull(), F.abs(q * price - total) > 0.01 + 1e-5 * F.abs(total)
        case "implies":
            return c.eqNullSafe(F.lit(p["value"])), ~other("then").eqNullSafe(F.lit(p["equals"]))
        case "in_range":
            return all_rows, _bad(number(c, t).between(p["low"], p["high"]))
        case "completeness_within":
            then = other("then")
            return F.coalesce(c.isin(*p["values"]), F.lit(False)), then.isNull() | (F.trim(then.cast("string")) == "")
        case "compact_date":
            return all_rows, F.try_to_date(c.try_cast("bigint").cast("string") if t != "string" else text, "yyyyMMdd").isNull()
        case "current":
            day = F.try_to_date(other("then").try_cast("bigint").cast("string"), "yyyyMMdd") if kinds[p["then"]] in ("int", "bigint") else parsed_date(other("then"), kinds[p["then"]])
            return c.eqNullSafe(F.lit(p["value"])), _bad(day >= F.lit(p["as_of"]).cast("date"))
        case "lookup":
            return F.col(f"_of_{_mark(rule)}"), ~F.col(f"_ok_{_mark(rule)}")
        case "predicate":
            return F.coalesce(F.expr(p.get("of", "true")), F.lit(False)), _bad(F.expr(p["passes"]))
    raise ValueError(f"unknown rule kind {rule.kind}")


def _text_of_row(columns: list[tuple[str, str]]) -> Column:
    """A text that two rows share only if their columns are equal: each value by its length and letters, null apart, -0.0 as 0.0."""
    def one(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        c = F.hex(c) if kind == "binary" else (c + F.lit(0.0)).cast("string") if kind in ("double", "float") else c.cast("string")
        return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.concat(*(one(c, t) for c, t in columns))


def repeats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n, bad): rows, and rows beyond the first of each value; nulls equal each other. Where texts are among the columns, values meet by the SHA-256 of all of them, so long rows are not shuffled."""
    kinds = dict(df.dtypes)
    texts = any(kinds[c].startswith(("string", "char", "varchar", "binary")) for c in columns)
    nested = any(kinds[c].startswith(("array", "map", "struct", "variant")) for c in columns)
    keys = [F.unhex(F.sha2(_text_of_row([(c, kinds[c]) for c in columns]), 256))] if texts and not nested else [F.col(f"`{c}`") for c in columns]
    counts = df.groupBy(*(k.alias(f"_key{i}") for i, k in enumerate(keys))).agg(F.count("*").alias("_times")).select("_times")
    return counts.agg(F.coalesce(F.sum("_times"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("_times") - 1), F.lit(0)).alias("bad"))


class BatchCheck:
    """A check of one's own over a dataset: columns read, and a state that batches are added to.

    start() gives an empty state, add(state, batch) takes an Arrow batch in, merge(a, b) joins the
    states of two tasks, result(state) is (rows that count, bad rows). States are pickled and have
    to stay small.
    """

    columns: list[str]

    def start(self) -> Any:
        return [0, 0]

    def add(self, state: Any, batch: pa.RecordBatch) -> Any:
        raise NotImplementedError

    def merge(self, a: Any, b: Any) -> Any:
        return [x + y for x, y in zip(a, b)]

    def result(self, state: Any) -> tuple[int, int]:
        return state[0], state[1]


def batch_counts(df: DataFrame, checks: dict[str, BatchCheck]) -> DataFrame:
    """(rule_id, n, bad) of many checks: one pass over the columns they read, a state per task and check, merged per check."""
    read = list(dict.fromkeys(c for k in checks.values() for c in k.columns))

    def states(batches):
        held = {k: c.start() for k, c in checks.items()}
        for b in batches:
            held = {k: checks[k].add(s, b.select(checks[k].columns)) for k, s in held.items()}
        yield pa.RecordBatch.from_pydict({"rule_id": list(held), "state": [pickle.dumps(s) for s in held.values()]})

    def merged(key: tuple, t: pa.Table) -> pa.Table:
        name = key[0].as_py()
        check = checks[name]
        n, bad = check.result(reduce(check.merge, map(pickle.loads, t.column("state").to_pylist()), check.start()))
        return pa.table({"rule_id": pa.array([name]), "n": pa.array([n], pa.int64()), "bad": pa.array([bad], pa.int64())})

    per_task = df.select(*(F.col(f"`{c}`") for c in read)).mapInArrow(states, "rule_id string, state binary")
    found = per_task.groupBy("rule_id").applyInArrow(merged, "rule_id string, n bigint, bad bigint")
    none = df.sparkSession.createDataFrame([(k, *map(int, c.result(c.start()))) for k, c in checks.items()], "rule_id string, n0 bigint, bad0 bigint")  # where there are no tasks
    return none.join(found, "rule_id", "left").select("rule_id", F.coalesce("n", "n0").alias("n"), F.coalesce("bad", "bad0").alias("bad"))


def _grouped(rule: Rule, df: DataFrame) -> DataFrame | None:
    """(n, bad) of the kinds that are not row-level."""
    if rule.kind == "unique":
        return repeats(df, rule.params.get("columns") or [rule.column])
    if rule.kind == "no_duplicate_rows":
        return repeats(df, df.columns)
    if rule.kind == "aggregate":  # any callable DataFrame -> (n, bad)
        return rule.params["check"](df)
    return None


def _with_flag(scan: DataFrame, rule: Rule, reference: DataFrame) -> DataFrame:
    """scan with _fk_<rule>: not null where the column's value is among the reference's keys.

    Null is found only if the reference holds null. Rows with a null key are spread over all tasks
    of the join, as there they meet nothing.
    """
    key, flag, salt, null = (f"_{k}_{_mark(rule)}" for k in ("ref", "fk", "salt", "null"))
    keys = reference.select(F.col(f"`{rule.params['key']}`").alias(key))
    nulls = keys.agg(F.max(F.when(F.col(key).isNull(), 1)).alias(null))  # one row
    known = keys.where(F.col(key).isNotNull()).distinct().select(key, F.lit(1).alias(flag), F.lit(0).alias(f"{salt}_r"))
    c = F.col(f"`{rule.column}`")
    dealt = scan.withColumn(salt, F.when(c.isNull(), F.monotonically_increasing_id() % 4096 + 1).otherwise(0).cast("int"))
    joined = dealt.join(known, (dealt[f"`{rule.column}`"] == known[key]) & (dealt[salt] == known[f"{salt}_r"]), "left").crossJoin(F.broadcast(nulls))
    found = F.when(c.isNull(), F.col(null)).otherwise(F.col(flag))
    return joined.withColumn(flag, found).drop(key, salt, f"{salt}_r", null)


def _with_lookup(scan: DataFrame, rule: Rule, reference: DataFrame) -> DataFrame:
    """scan with _of_<rule> and _ok_<rule>: the rule's predicates, which may use measures of a table joined by key.

    params: measure {name: aggregate}, on {column: column of the table} (none: one row of measures
    for all rows), passes, and of. Measures are grouped by key first, so rows stay one to one.
    """
    p, measures = rule.params, rule.params["measure"]
    if clash := set(measures) & set(scan.columns):
        raise ValueError(f"{rule.rule_id}: measures are named like columns: {', '.join(sorted(clash))}")
    on = p.get("on") or {}
    keys = [f"_on{i}_{_mark(rule)}" for i in range(len(on))]
    grouped = reference.groupBy(*(F.col(f"`{r}`").alias(k) for k, r in zip(keys, on.values()))).agg(*(F.expr(e).alias(m) for m, e in measures.items()))
    if on:
        grouped = reduce(lambda d, k: d.where(F.col(k).isNotNull()), keys, grouped)
        scan = scan.join(grouped, reduce(lambda a, b: a & b, (scan[f"`{c}`"] == grouped[k] for c, k in zip(on, keys))), "left")
    else:
        scan = scan.crossJoin(F.broadcast(grouped))  # one row
    ok, of = F.coalesce(F.expr(p["passes"]), F.lit(False)), F.coalesce(F.expr(p.get("of", "true")), F.lit(False))
    return scan.withColumns({f"_ok_{_mark(rule)}": ok, f"_of_{_mark(rule)}": of}).drop(*keys, *measures)


def counts(rules: list[Rule], tables: dict[str, DataFrame]) -> DataFrame:
    """(rule_id, n, bad): one fused scan per dataset for row-level rules, one for checks over batches, one grouping for each of the others."""
    out = []
    for dataset in dict.fromkeys(r.dataset for r in rules):
        df, fused, checks = tables[dataset], [], {}
        kinds, scan = dict(df.dtypes), df
        for r in (r for r in rules if r.dataset == dataset):
            if r.kind == "aggregate" and isinstance(r.params["check"], BatchCheck):
                checks[r.rule_id] = r.params["check"]
                continue
            if (own := _grouped(r, df)) is not None:
                out.append(own.select(F.lit(r.rule_id).alias("rule_id"), F.col("n").cast("bigint").alias("n"), F.col("bad").cast("bigint").alias("bad")))
                continue
            if r.kind == "fk":
                scan = _with_flag(scan, r, tables[r.params["table"]])
            if r.kind == "lookup":
                scan = _with_lookup(scan, r, tables[r.params.get("table", dataset)])
            fused.append((r, *predicate(r, kinds)))
        if fused:
            wide = scan.agg(*chain_aggs(fused))
            rows = F.explode(F.array(*(F.struct(F.lit(r.rule_id).alias("rule_id"), F.col(f"n{i}").alias("n"), F.col(f"b{i}").alias("bad")) for i, (r, _, _) in enumerate(fused))))
            out.append(wide.select(rows.alias("x")).select("x.rule_id", "x.n", "x.bad"))
        if checks:
            out.append(batch_counts(df, checks))
    return reduce(DataFrame.unionByName, out)


def chain_aggs(fused: list[tuple[Rule, Column, Column]]) -> list[Column]:
    return [a for i, (_, of, bad) in enumerate(fused) for a in (F.count_if(of).alias(f"n{i}"), F.count_if(of & bad).alias(f"b{i}"))]


def specs(spark: SparkSession, rules: list[Rule], lang: str = "en") -> DataFrame:
    """Rule specifications as rows, the description in lang or else in es."""
    rows = [(r.rule_id, r.dataset, r.column, r.dimension, r.description.get(lang) or r.description.get("es") or r.description.get("en") or "", float(r.threshold), k) for k, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_id string, dataset string, column string, dimension string, description string, threshold double, position int")


def _listed(text: str) -> list:
    out = json.loads(text)
    if not isinstance(out, list):
        raise ValueError("not a list")
    return out


def _mapped(text: str) -> dict[str, str]:
    out = json.loads(text)
    if not isinstance(out, dict) or not all(isinstance(v, str) for v in out.values()):
        raise ValueError("not a map of texts")
    return out


#: How each kind's parameters are read from text; names ending in ? may be missing.
PARAMETERS: dict[str, dict[str, Callable[[str], Any]]] = {
    "not_null": {}, "positive": {}, "compact_date": {}, "no_duplicate_rows": {}, "unique": {"columns?": _listed},
    "regex": {"pattern": str}, "matches_pattern": {"pattern": str}, "in_set": {"values": _listed}, "in_range": {"low": float, "high": float}, "max_age": {"as_of": str, "days": int}, "fk": {"table": str, "key": str},
    "not_placeholder": {"values?": _listed}, "not_marker": {"values?": _listed}, "valid_date": {"markers?": _listed, "formats?": _listed}, "numeric": {"markers?": _listed},
    "completeness_unless": {"value": str, "then": str}, "completeness_within": {"values": _listed, "then": str}, "implies": {"value": str, "then": str, "equals": str}, "current": {"value": str, "then": str, "as_of": str},
    "amount": {"quantity": str, "price": str, "total": str}, "predicate": {"passes": str, "of?": str}, "lookup": {"table?": str, "on?": _mapped, "measure": _mapped, "passes": str, "of?": str}, "aggregate": {"check": str},
}


def _parameters(kind: str, texts: dict[str, str], checks: dict[str, Callable | BatchCheck]) -> tuple[dict, list[str]]:
    """(parameters, what is wrong with them)."""
    known = {k.rstrip("?"): (read, k.endswith("?")) for k, read in PARAMETERS[kind].items()}
    texts = {k: v for k, v in texts.items() if v is not None}
    wrong = [f"unknown parameter {k}" for k in texts if k not in known] + [f"no parameter {k}" for k, (_, free) in known.items() if k not in texts and not free]
    out = {}
    for k, v in texts.items():
        if k in known:
            try:
                out[k] = known[k][0](v)
            except (ValueError, TypeError):
                wrong.append(f"parameter {k} cannot be read: {v!r}")
    if kind == "aggregate" and "check" in out:
        if out["check"] in checks:
            out["check"] = checks[out["check"]]
        else:
            wrong.append(f"unknown check {out['check']}")
    return out, wrong


def compiled(rows: Iterable[dict], checks: dict[str, Callable | BatchCheck] | None = None) -> list[Rule]:
    """Rules from rows (rule_id, dataset, column, dimension, kind; params, threshold and description if given).

    params maps names to texts: lists and maps are written as JSON. A rule of kind aggregate names
    one of checks. All faults of all rows are raised at once.
    """
    out, faults, seen = [], [], set()
    for k, row in enumerate(rows):
        name = row.get("rule_id") or f"row {k}"
        missing = [c for c in ("rule_id", "dataset", "column", "dimension", "kind") if not row.get(c)]
        wrong = [f"no {c}" for c in missing]
        if row.get("dimension") and row["dimension"] not in DIMENSIONS:
            wrong.append(f"unknown dimension {row['dimension']}")
        if name in seen:
            wrong.append("stands twice")
        seen.add(name)
        threshold = 95.0 if row.get("threshold") is None else float(row["threshold"])
        if not 0 <= threshold <= 100:
            wrong.append(f"threshold {threshold} is not between 0 and 100")
        params = {}
        if row.get("kind") and row["kind"] not in PARAMETERS:
            wrong.append(f"unknown kind {row['kind']}")
        elif row.get("kind"):
            params, more = _parameters(row["kind"], dict(row.get("params") or {}), checks or {})
            wrong += more
        faults += [f"{name}: {w}" for w in wrong]
        if not wrong:
            out.append(Rule(row["rule_id"], row["dataset"], row["column"], row["dimension"], row["kind"], params, threshold, dict(row.get("description") or {})))
    if faults:
        raise ValueError("; ".join(faults))
    return out


RULE_ROW = "rule_id string, dataset string, column string, dimension string, kind string, params map<string,string>, threshold double, description map<string,string>"


def rules_from_table(df: DataFrame, checks: dict[str, Callable | BatchCheck] | None = None) -> list[Rule]:
    """Rules from a table of rule rows, in the order of rule_id; columns that are missing count as null."""
    have = [c for c in (x.split()[0] for x in RULE_ROW.split(", ")) if c in df.columns]
    return compiled((r.asDict(recursive=True) for r in df.select(*have).orderBy("rule_id").collect()), checks)  # one row per rule


def rule_table(spark: SparkSession, rules: list[Rule], checks: dict[str, Callable | BatchCheck] | None = None) -> DataFrame:
    """Rules as the rows that compiled() reads."""
    names = {id(v): k for k, v in (checks or {}).items()}
    text = lambda v: names.get(id(v)) or (v if isinstance(v, str) else json.dumps(v))
    return spark.createDataFrame([(r.rule_id, r.dataset, r.column, r.dimension, r.kind, {k: text(v) for k, v in r.params.items()}, float(r.threshold), r.description) for r in rules], RULE_ROW)


def graded(counted: DataFrame, band: float = 2.0) -> DataFrame:
    """score (two decimals, half even) and status from n, bad and threshold: the rounded score is compared."""
    score = F.when(F.col("n") == 0, 100.0).otherwise(F.bround(100.0 * (F.col("n") - F.col("bad")) / F.col("n"), 2))
    status = F.when(F.col("score") >= F.col("threshold"), "pass").when(F.col("score") >= F.col("threshold") - band, "warn").otherwise("fail")
    return counted.withColumn("score", score).withColumn("status", status).withColumn("affected_rows", F.col("bad"))


def evaluate_rules(spark: SparkSession, rules: list[Rule], tables: dict[str, DataFrame], lang: str = "en", band: float = 2.0) -> DataFrame:
    """One row per rule; no rules: no rows, same columns."""
    if not rules:
        return spark.createDataFrame([], "rule_id string, dataset string, column string, dimension string, description string, score double, threshold double, status string, affected_rows bigint")
    joined = specs(spark, rules, lang).join(counts(rules, tables), "rule_id")
    return graded(joined, band).select(*RESULT_COLUMNS)


def auto_rules(profile: list, rows: int, duplicates: bool = True, dataset: str = "table") -> list[Rule]:
    """Rules from a column profile (rows of column, null_pct, unique_values): completeness where up to half is null, uniqueness where all values differ, and whole-row duplicates."""
    found: list[tuple[str, str, str, float]] = []
    for r in profile:
        if 0 < r["null_pct"] <= 50:
            found.append((r["column"], "completeness", "not_null", 95.0))
        if rows > 1 and r["null_pct"] == 0 and r["unique_values"] == rows:
            found.append((r["column"], "uniqueness", "unique", 100.0))
    if rows and duplicates:
        found.append(("*", "uniqueness", "no_duplicate_rows", 98.0))
    texts = {"not_null": "{c} is filled in", "unique": "{c} does not repeat", "no_duplicate_rows": "no row repeats"}
    return [Rule(f"AUTO-{k:02d}", dataset, c, d, kind, {}, t, {"en": texts[kind].format(c=c)}) for k, (c, d, kind, t) in enumerate(found, 1)]
