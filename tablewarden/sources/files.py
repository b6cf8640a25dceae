"""File sources, sinks and snapshots, scans of many sources, and what SQL texts for databases need."""

from __future__ import annotations

import itertools
import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_delimited(spark: SparkSession, path: str, cap: int | None = None) -> tuple[DataFrame, bool]:
    """(table, cut): the separator is the commonest of , ; tab | in the first line; with a cap, whether rows were left out."""
    line = spark.read.text(path).limit(1).collect()
    first = line[0][0] if line else ""
    sep = max([",", ";", "\t", "|"], key=first.count)
    df = spark.read.option("header", True).option("inferSchema", True).option("sep", sep).csv(path)
    if cap is None:
        return df, False
    return df.limit(cap), df.limit(cap + 1).count() > cap


def read_as(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    return spark.read.format(fmt).options(**({"header": "true", "inferSchema": "true"} if fmt == "csv" else {})).load(path)


MOST_ROWS = 100_000


def mark_of(url: str) -> str:
    """The quotation mark of names in the dialect of a JDBC url."""
    return "`" if url.split(":")[1].lower() in ("mysql", "mariadb") else '"'


def quoted(url: str, table: str) -> str:
    """A table's name quoted part by part."""
    mark = mark_of(url)
    return ".".join(mark + part.replace(mark, mark * 2) + mark for part in table.split("."))


def limited(url: str, relation: str, limit: int) -> str:
    """A query of the first rows (1 to 100000) of a relation in the dialect of a JDBC url."""
    n, kind = min(max(limit, 1), MOST_ROWS), url.split(":")[1].lower()
    if kind == "sqlserver":
        return f"SELECT TOP {n} * FROM {relation}"
    if kind in ("mysql", "mariadb", "postgresql", "sqlite", "duckdb", "h2", "snowflake", "databricks"):
        return f"SELECT * FROM {relation} LIMIT {n}"
    return f"SELECT * FROM {relation} FETCH FIRST {n} ROWS ONLY"


def limited_query(url: str, table: str, limit: int) -> str:
    """A query of the first rows (1 to 100000) of a table."""
    return limited(url, quoted(url, table), limit)


def guarded(sql: str) -> str:
    """The text, if its first word after comments and brackets is select or with; else an error."""
    rest = sql
    while True:
        rest = rest.lstrip(" \t\r\n(")
        if rest.startswith("--"):
            rest = rest.partition("\n")[2]
        elif rest.startswith("/*"):
            rest = rest.partition("*/")[2]
        else:
            break
    word = "".join(itertools.takewhile(str.isalpha, rest)).casefold()
    if word not in {"select", "with"}:
        raise ValueError("only queries that read are allowed")
    return sql


SCAN = "conn_id string, name string, engine string, table string, column string, type string, error string"


def scan_sources(spark: SparkSession, sources: dict[str, dict], at_once: int = 8) -> DataFrame:
    """(conn_id, name, engine, table, column, type, error) over sources {conn_id: {name, engine, catalog: () -> DataFrame(table, column, type)}}.

    Every catalogue is read here, some at once, and written to scratch. So a source that fails,
    be it in planning or in reading, is an error row and leaves the others alone; an empty one is
    a row without table.
    """
    columns = "table string, column string, type string, error string"

    def one(conn: str) -> DataFrame:
        s = sources[conn]
        try:
            rows = written(s["catalog"]().select(*(F.col(c).cast("string").alias(c) for c in ("table", "column", "type")), F.lit(None).cast("string").alias("error")))
            if rows.isEmpty():
                rows = spark.createDataFrame([(None,) * 4], columns)
        except Exception as e:  # one bad source does not stop the others
            rows = spark.createDataFrame([(None, None, None, str(e).strip().split("\n")[0][:255])], columns)
        return rows.select(F.lit(conn).alias("conn_id"), F.lit(s["name"]).alias("name"), F.lit(s["engine"]).alias("engine"), "*")

    if not sources:
        return spark.createDataFrame([], SCAN)
    with ThreadPoolExecutor(at_once) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, sources))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One record a line; NaN as null, nulls kept, ISO dates."""
    clean = df.select(*((F.nanvl(F.col(c), F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(c)) for c, t in df.dtypes))
    clean.write.option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def write_bundle(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    for name, df in tables.items():
        {"csv": write_csv, "json": write_json, "parquet": write_parquet}[fmt](df, f"{path}/{name}")


MANIFEST = "client_id string, stage_id string, kind string, notes string, created_at timestamp, table string, rows bigint, columns bigint, save string"


def save_stage(spark: SparkSession, root: str, client: str, stage: str, tables: dict[str, DataFrame], kind: str = "", notes: str = "", at: datetime | None = None) -> DataFrame:
    """Write a stage's tables and its manifest; empty tables are dropped, a stage of none is an error, the same stage is replaced as a whole. Returns the manifest rows.

    Tables go to a folder of this save's own and are counted as written; only the manifest tells
    which save is the stage, so a reader never meets half of one.
    """
    save, kept = uuid.uuid4().hex, {}
    for name, df in tables.items():
        path = f"{root}/data/{client}/{stage}/{save}/{name}"
        df.write.parquet(path)
        if n := spark.read.schema(df.schema).parquet(path).count():
            kept[name] = (n, len(df.columns))
    if not kept:
        raise ValueError("a stage needs at least one table with rows")
    when = at or datetime.now(timezone.utc).replace(tzinfo=None)
    rows = spark.createDataFrame([(client, stage, kind, notes, when, k, n, width, save) for k, (n, width) in kept.items()], MANIFEST)
    rows.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/{client}/{stage}")
    return rows


def _manifest(spark: SparkSession, root: str, client: str) -> DataFrame:
    """A client's manifest rows; none where the client has no stages."""
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).option("ignoreMissingFiles", True).parquet(f"{root}/manifest").where(F.col("client_id") == client)


def list_stages(spark: SparkSession, root: str, client: str) -> DataFrame:
    """Stages of a client, newest first."""
    m = _manifest(spark, root, client)
    return m.groupBy("stage_id", "kind", "notes", "created_at").agg(F.count("*").alias("tables"), F.sum("rows").alias("rows")).orderBy(F.desc("created_at"), "stage_id")


def load_stage(spark: SparkSession, root: str, client: str, stage: str) -> dict[str, DataFrame]:
    rows = _manifest(spark, root, client).where(F.col("stage_id") == stage).collect()  # one row per table
    return {r["table"]: spark.read.parquet(f"{root}/data/{client}/{stage}/{r['save']}/{r['table']}") for r in rows}


def stage_summary(spark: SparkSession, root: str, client: str) -> DataFrame:
    """One row: stages, tables, rows and the last update."""
    return _manifest(spark, root, client).agg(F.count_distinct("stage_id").alias("stages"), F.count("*").alias("tables"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.max("created_at").alias("last_update"))
