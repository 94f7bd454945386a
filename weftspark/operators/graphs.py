"""Reachability over edge tables, by rounds that stop when nothing new is reached."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the cluster's checkpoint folder; a local folder only where none is set and the master is local."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(root or "file://" + tempfile.mkdtemp(prefix="weft-graph-"))
    return df.checkpoint()


def reach(edges: DataFrame, roots: DataFrame, hops: int | None = None) -> DataFrame:
    """node and the least number of edges from a root; edges(src, dst), roots(node). Without ``hops`` until nothing new is reached.

    Each round joins only the newest frontier, drops nodes reached before, and is settled before the next.
    """
    edges = settled(edges.select("src", "dst"))
    frontier = known = settled(roots.select("node", F.lit(0).alias("hops")).distinct())
    k = 0
    while k != hops:
        k += 1
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = settled(step.join(known.select("node"), "node", "left_anti").select("node", F.lit(k).alias("hops")))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def longest_prefix(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """path and the longest root that is one of its ancestor folders; null without one. paths(path), roots(root)."""
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    owned = paths.select("path", F.explode(ancestors).alias("root")).join(roots, "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("owner"))
    return paths.join(owned, "path", "left").select("path", "owner")
