"""Databases over JDBC: whole tables by ranges of a key, first rows and guarded queries, Spark catalogues, and scans of many databases at once.

Spark's own JDBC source does the reading: a table with a key is read by as many tasks as its rows
ask for, filters and columns go to the database, a cap on rows is part of the text that the
database runs. A table attached as a catalogue has its aggregates computed there too, and its
limits where Spark's dialect of the engine has them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from .files import MOST_ROWS, guarded, limited, mark_of, quoted, scan_sources


@dataclass(frozen=True)
class Connection:
    """A database: where it is, further JDBC options (user, password, driver), and the schema whose tables go by their bare names."""

    conn_id: str
    name: str
    url: str
    options: dict[str, str] = field(default_factory=dict)
    schema: str | None = None

    @property
    def engine(self) -> str:
        return self.url.split(":")[1].lower()


def reader(spark: SparkSession, c: Connection) -> DataFrameReader:
    return spark.read.format("jdbc").options(**{"fetchsize": "10000", "preferTimestampNTZ": "true"} | c.options, url=c.url)


def bounds(spark: SparkSession, c: Connection, table: str, key: str) -> tuple:
    """(least key, greatest key, rows), computed by the database."""
    k = mark_of(c.url) + key + mark_of(c.url)
    return tuple(reader(spark, c).option("query", f"SELECT MIN({k}) AS low, MAX({k}) AS high, COUNT(*) AS n FROM {quoted(c.url, table)}").load().first())


def whole_table(spark: SparkSession, c: Connection, table: str, key: str | None = None, rows_a_task: int = 500_000, connections: int = 32) -> DataFrame:
    """All rows of a table; with a key (a number, date or timestamp) in equal ranges of it, each by a connection of its own, null keys with the first.

    Without a key, or where all rows fit one task, one connection reads it.
    """
    whole = reader(spark, c).option("dbtable", quoted(c.url, table))
    if key is None:
        return whole.load()
    low, high, n = bounds(spark, c, table, key)
    parts = min(connections, -(-n // rows_a_task))
    if low is None or parts < 2:
        return whole.load()
    return whole.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)).load()


def first_rows(spark: SparkSession, c: Connection, table: str, limit: int = 10_000) -> DataFrame:
    """At most limit (1 to 100000) rows of a table; the database cuts them off."""
    return reader(spark, c).option("query", limited(c.url, quoted(c.url, table), limit)).load()


def read_query(spark: SparkSession, c: Connection, sql: str, limit: int = 10_000) -> DataFrame:
    """At most limit (1 to 100000) rows of one query that only reads. The database cuts them off, but for queries that begin with WITH, which Spark cuts."""
    text = guarded(sql).strip().rstrip(";")
    if re.search(";", re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/", "", text, flags=re.S)):
        raise ValueError("only one query at a time")
    if re.match(r"(?is)\s*with\b", text):
        return reader(spark, c).option("query", text).load().limit(min(max(limit, 1), MOST_ROWS))
    return reader(spark, c).option("query", limited(c.url, f"({text}) q", limit)).load()


def attach(spark: SparkSession, c: Connection, catalog: str) -> str:
    """The database as a Spark catalogue of this name: spark.table("catalog.schema.table"), with filters, columns and aggregates computed there."""
    base = f"spark.sql.catalog.{catalog}"
    spark.conf.set(base, "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
    for k, v in ({"pushDownAggregate": "true", "pushDownLimit": "true", "preferTimestampNTZ": "true"} | c.options | {"url": c.url}).items():
        spark.conf.set(f"{base}.{k}", v)
    return catalog


def save_table(df: DataFrame, c: Connection, table: str, mode: str = "errorifexists", connections: int = 8, letters: int = 4000) -> None:
    """Write df into a table over at most so many connections; each task's rows are one transaction, so a task that is repeated after its commit repeats its rows.

    Texts become VARCHAR where the engine's own choice would be a large object, which keys and comparisons do not take.
    """
    texts = ", ".join(f"`{k}` VARCHAR({letters})" for k, t in df.dtypes if t == "string") if c.engine in ("derby", "oracle", "db2") else ""
    options = {"createTableColumnTypes": texts} if texts else {}
    df.write.format("jdbc").options(**c.options, **options, url=c.url, dbtable=quoted(c.url, table), numPartitions=str(connections), batchsize="5000").mode(mode).save()


#: Schemas that belong to the engines themselves.
OWN_SCHEMAS = ["information_schema", "pg_catalog", "sys", "mysql", "performance_schema", "system", "xdb", "mdsys", "ctxsys"]
_STANDARD = "SELECT table_schema AS s, table_name AS t, column_name AS c, data_type AS d, ordinal_position AS p FROM information_schema.columns"
#: The engines' catalogues as (schema, table, column, type, position); the standard's view unless said otherwise.
CATALOGUES = {
    "derby": "SELECT s.schemaname AS s, t.tablename AS t, c.columnname AS c, CAST(c.columndatatype AS VARCHAR(200)) AS d, c.columnnumber AS p FROM sys.systables t JOIN sys.sysschemas s ON t.schemaid = s.schemaid JOIN sys.syscolumns c ON c.referenceid = t.tableid WHERE t.tabletype = 'T'",
    "oracle": "SELECT owner AS s, table_name AS t, column_name AS c, data_type AS d, column_id AS p FROM all_tab_columns",
    "sqlite": "SELECT 'main' AS s, m.name AS t, x.name AS c, x.type AS d, x.cid AS p FROM sqlite_master m JOIN pragma_table_info(m.name) x WHERE m.type = 'table'",
    "db2": "SELECT tabschema AS s, tabname AS t, colname AS c, typename AS d, colno AS p FROM syscat.columns",
}
#: Schemas of tables that go by their bare names.
DEFAULT_SCHEMAS = {"derby": "APP", "postgresql": "public", "sqlserver": "dbo", "sqlite": "main", "duckdb": "main", "h2": "PUBLIC", "snowflake": "PUBLIC"}


def catalogue(spark: SparkSession, c: Connection) -> DataFrame:
    """(table, column, type) of all tables a connection sees but the engine's own; tables outside the default schema go by schema.table."""
    found = reader(spark, c).option("query", CATALOGUES.get(c.engine, _STANDARD)).load().toDF("s", "t", "c", "d", "p")
    plain = c.schema or DEFAULT_SCHEMAS.get(c.engine)
    name = F.col("t") if plain is None and c.engine in ("mysql", "mariadb") else F.when(F.lower("s") == (plain or "").lower(), F.col("t")).otherwise(F.concat_ws(".", "s", "t"))
    return found.where(~F.lower("s").isin(*OWN_SCHEMAS)).select(name.alias("table"), F.col("c").alias("column"), F.col("d").alias("type"))


def scan(spark: SparkSession, connections: list[Connection]) -> DataFrame:
    """(conn_id, name, engine, table, column, type, error) over many databases; one that cannot be read is an error row, one without tables a row without table."""
    return scan_sources(spark, {c.conn_id: {"name": c.name, "engine": c.engine, "catalog": lambda c=c: catalogue(spark, c)} for c in connections})
