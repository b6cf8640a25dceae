"""Rule evaluation over streams: each micro-batch is evaluated like a table and its results appended."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.rules import Rule, evaluate_rules


def evaluate_stream(stream: DataFrame, rules: list[Rule], dataset: str, path: str) -> DataStreamWriter:
    """A writer that appends every micro-batch's rule results, stamped with run_ts, to the Parquet table at path; start() it."""

    def run(batch: DataFrame, _: int) -> None:
        stamp = datetime.now(timezone.utc).replace(tzinfo=None)
        results = evaluate_rules(batch.sparkSession, rules, {dataset: batch})
        results.withColumn("run_ts", F.lit(stamp)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(run)
