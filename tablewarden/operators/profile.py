"""Column profiles of tables from one aggregate over all columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import pii_name
from .rules import repeats

EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
PROFILE = "column string, dtype string, null_pct double, unique_values bigint, sample string, possible_pii boolean"


def _value_key(c: str, kind: str) -> Column:
    """A text of at most 65 letters that two values share only if they are equal."""
    x = F.col(f"`{c}`")
    if kind.startswith(("array", "struct", "map")):
        text = F.to_json(F.struct(x), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"})
        text = F.when(x.isNotNull(), text)
    else:
        text = F.hex(x) if kind == "binary" else (x + F.lit(0.0)).cast("string") if kind in ("double", "float") else x.cast("string")
    return F.when(F.octet_length(text) <= 32, text).otherwise(F.concat(F.lit("#"), F.sha2(text, 256)))


def distinct_counts(df: DataFrame, columns_at_once: int = 50) -> DataFrame:
    """(position, unique_values) of the columns that have values; some columns a pass, each value by a short key.

    A pass reads its own columns only and sends a key per column and value, met within tasks
    first; rows are not copied whole for every column as they are for distinct counts side by side.
    """
    each = []
    for k in range(0, len(df.columns), columns_at_once):
        keys = F.array(*(F.struct(F.lit(i).alias("position"), _value_key(c, t).alias("value")) for i, (c, t) in list(enumerate(df.dtypes))[k : k + columns_at_once]))
        values = df.select(F.explode(keys).alias("x")).select("x.*").where("value is not null").groupBy("position", "value").agg(F.lit(1).alias("_one"))
        each.append(values.groupBy("position").agg(F.count("*").alias("unique_values")))
    return reduce(DataFrame.unionByName, each)


def _side_by_side(df: DataFrame, columns: list[tuple[int, str, str]], order: str | None, approximate: bool) -> DataFrame:
    """A row for each of some columns (position, name, type), from one aggregate over them."""
    aggs: list[Column] = [F.count("*").alias("n")]
    for i, c, _ in columns:
        x = F.col(f"`{c}`")
        text = F.substring(x.cast("string"), 1, 40)
        first = F.min_by(text, F.when(x.isNotNull(), F.col(f"`{order}`"))) if order else F.first(text, ignorenulls=True)
        aggs += [F.count(x).alias(f"c{i}"), (F.approx_count_distinct(x) if approximate else F.lit(None).cast("bigint")).alias(f"d{i}"), first.alias(f"s{i}")]
    rows = F.explode(F.array(*(F.struct(
        F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("dtype"),
        F.when(F.col("n") == 0, 0.0).otherwise(F.bround(100.0 * (F.col("n") - F.col(f"c{i}")) / F.col("n"), 2)).alias("null_pct"),
        F.col(f"d{i}").alias("sketched"), F.coalesce(f"s{i}", F.lit("")).alias("sample")) for i, c, t in columns)))
    return df.agg(*aggs).select(rows.alias("x")).select("x.*")


def profile_table(df: DataFrame, order: str | None = None, approximate: bool = False, columns_at_once: int = 50) -> DataFrame:
    """One row per column: dtype, null % (two decimals), distinct non-null values, first non-null value (40 letters; by the order column), possible PII by name or by e-mail values.

    approximate counts distinct values by sketch, for very large tables. Wide tables are read some
    columns at a time. An empty table has a row per column too.
    """
    columns = [(i, c, t) for i, (c, t) in enumerate(df.dtypes)]
    flat = reduce(DataFrame.unionByName, (_side_by_side(df, columns[k : k + columns_at_once], order, approximate) for k in range(0, len(columns), columns_at_once)))
    if approximate:
        flat = flat.withColumnRenamed("sketched", "unique_values")
    else:
        flat = flat.join(distinct_counts(df, columns_at_once), "position", "left").withColumn("unique_values", F.coalesce("unique_values", F.lit(0)))
    pii = pii_name(F.col("column")) | (F.coalesce("share", F.lit(0.0)) > 0.5)
    return flat.join(email_share(df, order), "column", "left").withColumn("possible_pii", pii).orderBy("position").select("column", "dtype", "null_pct", "unique_values", "sample", "possible_pii")


def email_share(df: DataFrame, order: str | None = None, first: int = 50) -> DataFrame:
    """(column, share): how many of a text column's first non-null values look like e-mail addresses."""
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, share double")
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("v"), F.col(f"`{order or c}`").cast("string" if not order else dict(df.dtypes)[order]).alias("o")) for c in texts))).alias("x")
    flat = df.select(values).select("x.*").where("v is not null").selectExpr("*", "row_number() over (partition by column order by o, v) as k").where(f"k <= {first}")
    return flat.groupBy("column").agg(F.avg(F.col("v").rlike(EMAIL).cast("int")).alias("share"))


def summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, duplicate_rows, null_cell_pct, pii_columns (by name or by e-mail values)."""
    nulls = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0))
    cells = df.agg(F.count("*").alias("rows"), nulls.alias("nulls"))
    repeated = repeats(df, df.columns).select(F.col("bad").alias("duplicate_rows"))
    width = len(df.columns)
    found = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string").join(email_share(df), "column", "left")
    names = found.agg(F.count_if(pii_name(F.col("column")) | (F.coalesce("share", F.lit(0.0)) > 0.5)).alias("pii_columns"))
    pct = F.when(F.col("rows") == 0, 0.0).otherwise(F.bround(100.0 * F.col("nulls") / (F.col("rows") * width), 2))
    return cells.crossJoin(repeated).crossJoin(names).select("rows", F.lit(width).cast("bigint").alias("columns"), "duplicate_rows", pct.alias("null_cell_pct"), "pii_columns")


def suggestions(profile: DataFrame, rows: int, duplicates: int, most: int = 12) -> DataFrame:
    """(suggestion, column): not-null where up to a fifth is null, unique where all differ, PII columns to protect, and repeated rows; the first `most`."""
    base = profile.withColumn("position", F.monotonically_increasing_id())
    each = F.array_compact(F.array(
        F.when((F.col("null_pct") > 0) & (F.col("null_pct") <= 20), F.struct(F.lit(1).alias("o"), F.lit("not_null").alias("suggestion"))),
        F.when((F.col("null_pct") == 0) & (F.col("unique_values") == rows) & F.lit(rows > 1), F.struct(F.lit(2).alias("o"), F.lit("unique").alias("suggestion"))),
        F.when(F.col("possible_pii"), F.struct(F.lit(3).alias("o"), F.lit("protect").alias("suggestion")))))
    found = base.select("column", "position", F.explode(each).alias("x")).select("x.suggestion", "column", "position", "x.o")
    if duplicates:
        found = found.unionByName(profile.sparkSession.createDataFrame([("deduplicate", "*", 1 << 60, 4)], "suggestion string, column string, position bigint, o int"))
    return found.orderBy("position", "o").limit(most).select("suggestion", "column")


def blocking_columns(profile: DataFrame) -> DataFrame:
    """Columns of few values (2 to 30), fit for blocking."""
    return profile.where("unique_values between 2 and 30").select("column", "unique_values")
