"""Column masks, row policies and access plans, applied to DataFrames; search and filters over metadata tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import masked_email


def masked(df: DataFrame, dictionary: DataFrame, dataset: str) -> DataFrame:
    """df with its PII columns (dictionary: dataset, column, pii) replaced by ***, e-mail columns by a masked address."""
    pii = {r["column"] for r in dictionary.where((F.col("dataset") == dataset) & F.col("pii")).select("column").collect()}
    hide = lambda c: masked_email(F.col(c)) if "mail" in c.lower() else F.when(F.col(c).isNotNull(), F.lit("***"))
    return df.select(*((hide(c).alias(c) if c in pii else F.col(c)) for c in df.columns))


def row_policy(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def entitled(df: DataFrame, column: str, entitlements: DataFrame, user: str) -> DataFrame:
    """Rows whose value the user (entitlements: user, value) may see."""
    mine = entitlements.where(F.col("user") == user).select(F.col("value").alias("_value"))
    return df.join(mine, df[column] == mine["_value"], "left_semi")


def access_plan(catalog: DataFrame, roles: DataFrame) -> DataFrame:
    """(dataset, classification, role) for roles by classification; role is null where none may."""
    return catalog.join(roles, "classification", "left").select("dataset", "classification", "role")


def search_rows(df: DataFrame, text: str) -> DataFrame:
    """Rows with the text anywhere in their columns, whatever the case."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *(F.col(f"`{c}`").cast("string") for c in df.columns))), F.lit(text.lower())))


def search_tables(tables: dict[str, tuple[DataFrame, list[str], str]], text: str) -> DataFrame:
    """(kind, item) over tables given as name -> (table, columns searched, column shown); literal, at least two letters."""
    if len(text.strip()) < 2:
        raise ValueError("at least two letters")
    low = F.lit(text.strip().lower())
    hits = [df.where(reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(F.col(c).cast("string")), low), F.lit(False)) for c in columns))).select(F.lit(kind).alias("kind"), F.col(shown).cast("string").alias("item")) for kind, (df, columns, shown) in tables.items()]
    return reduce(DataFrame.unionByName, hits)


def equal(df: DataFrame, **values: object) -> DataFrame:
    """Equality filters; None leaves a column open."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])) if kv[1] is not None else d, values.items(), df)


def labelled_codes(df: DataFrame, column: str, labels: dict[str, str]) -> DataFrame:
    table = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    return df.withColumn(f"{column}_label", F.coalesce(F.element_at(table, F.col(column)), F.col(column)))


def preview(df: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    return df.orderBy(*order).limit(n)


def pii_columns(dictionary: DataFrame) -> DataFrame:
    return dictionary.where("pii").select("dataset", "column")


def governed_views(tables: dict[str, DataFrame], described: DataFrame, plan: DataFrame, members: DataFrame, entitlements: DataFrame, user: str, clear: frozenset[str] = frozenset()) -> dict[str, str]:
    """Temporary views of the tables as one user may see them, for spark.sql; returns {dataset: view}.

    plan (dataset, role; see access_plan) and members (user, role) tell which datasets the user
    gets a view of at all. Personal columns by the dictionary (dataset, column, pii) are masked in
    it, unless one of the user's roles for the dataset is in `clear`. Where entitlements (user,
    dataset, column, value) name a column of the dataset, whoever they are for, the view holds
    only rows whose value is among the user's own; several columns hold together. Views of an
    earlier call that the user no longer gets are dropped.
    """
    mine = members.where(F.col("user") == user).select("role").distinct()
    granted: dict[str, set[str]] = {}
    for r in plan.join(mine, "role").select("dataset", "role").distinct().collect():  # metadata: datasets by roles
        granted.setdefault(r["dataset"], set()).add(r["role"])
    policies = [(r["dataset"], r["column"]) for r in entitlements.select("dataset", "column").distinct().orderBy("dataset", "column").collect()]
    out = {}
    for dataset, df in tables.items():
        view = f"{user}_{dataset}"
        if dataset not in granted:
            df.sparkSession.catalog.dropTempView(view)
            continue
        for k, (_, column) in enumerate(p for p in policies if p[0] == dataset):
            allowed = entitlements.where((F.col("user") == user) & (F.col("dataset") == dataset) & (F.col("column") == column)).select(F.col("value").cast("string").alias(f"_allowed{k}"))
            df = df.join(allowed, df[f"`{column}`"].cast("string") == allowed[f"_allowed{k}"], "left_semi")
        seen = df if granted[dataset] & clear else masked(df, described, dataset)
        seen.createOrReplaceTempView(view)
        out[dataset] = view
    return out
