"""Result tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def write_results(results: dict[str, DataFrame], path: str, fmt: str = "parquet", partition_by: str | None = None, cluster_by: str | None = "strategy_id") -> None:
    """Every result table below `path`. A re-run replaces a table as a whole, so a retried job is safe.

    The rows of one `cluster_by` value lie together in one of the files, whose number does not follow that of the values.
    `partition_by` instead makes a folder per value, for columns with few values.
    """
    for name, df in results.items():
        by = partition_by if partition_by and partition_by in df.columns and fmt == "parquet" else None
        if by is None and cluster_by and cluster_by in df.columns:
            df = df.repartition(cluster_by).sortWithinPartitions(cluster_by)
        writer = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        if by:
            writer = writer.partitionBy(by)
        writer.save(f"{path}/{name}")


def read_results(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.option("header", True) if fmt == "csv" else reader).load(f"{path}/{name}")


def write_ordered(df: DataFrame, path: str, order: list[str], files: int | None = None) -> None:
    """`df` in order over numbered files: ranges of `order` go to files in turn, each sorted inside. No task sorts it all."""
    dealt = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def read_ordered(spark: SparkSession, path: str, position="position") -> DataFrame:
    """What `write_ordered` wrote, with each row's place from 1: its row in its file and the rows of the files before."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    sizes = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)  # a row per file
    starts = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_file").withColumn(position, F.col("_start") + F.col("_index") + 1).drop("_file", "_index", "_start")
