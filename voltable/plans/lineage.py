"""Cutting lineage by writing a table to the cluster's shared folder.

A written table survives lost executors, is columnar, and gives the optimizer a short plan with real
sizes. The folder is `spark.checkpoint.dir`; where it is unset, the warehouse, which a cluster shares as well.
What was written is removed when the session's file system closes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    return spark.conf.get(SETTING, None) or spark.conf.get("spark.sql.warehouse.dir")


def new_path(spark: SparkSession, name: str = "table") -> str:
    """A path in the shared folder that nobody uses yet, removed at the end of the session."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def still_written(df: DataFrame) -> bool:
    """Whether the files that `df` reads exist."""
    sc = df.sparkSession.sparkContext
    paths = [sc._jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    return all(p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p) for p in paths)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` once and continue from the written table."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
