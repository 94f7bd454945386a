"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm.shared import delete_path, work_path


def _ordered(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with v < u."""
    return edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, first: str, second: str) -> DataFrame:
    """node and component (the smallest node that it reaches) for every node of an edge between two different nodes.

    Every round writes its edges to the shared folder, so lineage stays short
    and no part of the graph passes through the driver; rounds grow with the
    logarithm of the longest path. Null ends and loops are ignored.
    """
    spark = edges.sparkSession
    held, told, path = _ordered(edges.select(F.col(first).alias("u"), F.col(second).alias("v"))).distinct(), None, None
    while True:
        now = work_path(spark, "edges")
        held.write.parquet(now)
        held = spark.read.schema(held.schema).parquet(now)
        sums = held.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if path:
            delete_path(spark, path)
        path = now
        if told == sums or not sums["n"]:
            return held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(held.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        told, held = sums, _ordered(_small_star(_ordered(_large_star(held)))).distinct()
