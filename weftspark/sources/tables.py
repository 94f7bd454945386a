"""Loader for the Parquet tables that the queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the path may be on any file system Spark reads."""
    if name not in TABLE_NAMES:
        raise ValueError(f"unknown table: {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Short rows that much is made from, dealt to all cores before it is made: a small file may be one task's, however long its rows take."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)
