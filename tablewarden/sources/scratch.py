"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; where that is unset, a local one for local sessions and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: a folder that all executors share is needed")
    return f"{(base or tempfile.gettempdir() + '/checkpoints').rstrip('/')}/scratch-{spark.sparkContext.applicationId}"


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path in the application's folder."""
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write df to scratch and read it back, to cut lineage between rounds."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> bool:
    """Remove all scratch tables of this application, whatever the file system; DataFrames that still read them fail from then on. Whether there were any."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
