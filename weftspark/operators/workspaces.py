"""Workspaces of packages: kinds, pooling, order, gates and which rules run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Adapters of applications, and those that a project with both routers runs.
APPLICATION_ADAPTERS = ("astro", "next-app-router", "next-hybrid-router", "next-pages-router", "tanstack-start", "laravel-inertia")
HYBRID = ("core", "next-app-router", "next-hybrid-router", "next-pages-router")


def classified(packages: DataFrame) -> DataFrame:
    """Adds kind and reason; packages(adapter, has_entry, error). A package with an error has neither and stays as a row."""
    shell = F.col("adapter").isin(*APPLICATION_ADAPTERS)
    kind = F.when(F.col("error").isNotNull(), None).when(shell | F.col("has_entry"), "application").otherwise("library")
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(shell, F.concat("adapter", F.lit(" is an application"))).when(F.col("has_entry"), "has an entry point").otherwise("has no entry point")
    return packages.withColumns({"kind": kind, "reason": reason})


def pooled(projects: DataFrame, key: str) -> DataFrame:
    """Adds pools: applications count, libraries only in a workspace without any; rows with errors never."""
    some = F.bool_or(F.col("kind") == "application").over(Window.partitionBy(key))
    return projects.withColumn("pools", F.when(F.col("kind").isNull(), False).otherwise(~some | (F.col("kind") == "application")))


def workspace_rows(projects: DataFrame, key: str) -> DataFrame:
    """One row a workspace: pooled adapter (mixed if several), representative package, coverage and mean score."""
    counts = F.col("pools")
    adapters = F.countDistinct(F.when(counts, F.col("adapter")))
    return projects.groupBy(key).agg(
        F.when(adapters == 1, F.max(F.when(counts, F.col("adapter")))).otherwise("mixed").alias("adapter"),
        F.min_by("package", F.struct((~counts).alias("last"), "package")).alias("representative"),
        F.when(F.count("error") > 0, "partial").otherwise("complete").alias("coverage"),
        F.floor(F.avg(F.when(counts, F.col("score"))) + 0.5).cast("long").alias("score"),
    )


def gate_fails(score: Column, least: int, coverage: Column) -> Column:
    """Whether a score gate fails: too low, none, or not everything was seen."""
    return (coverage == "partial") | score.isNull() | (score < least)


def worst_first(projects: DataFrame, key: str) -> DataFrame:
    """Adds place: worst score first, rows without one last."""
    by = Window.partitionBy(key).orderBy(F.asc_nulls_last("score"), "package")
    return projects.withColumn("place", F.row_number().over(by).cast("long"))


def rule_runs(rule_adapters: Column, adapter: Column) -> Column:
    """Whether a rule of these adapters runs on a project of this adapter."""
    own = F.array_contains(rule_adapters, "core") | F.array_contains(rule_adapters, adapter)
    return F.when(adapter == "next-hybrid-router", F.arrays_overlap(rule_adapters, F.array(*map(F.lit, HYBRID)))).otherwise(own)


def filtered(actionables: DataFrame, category: str | None = None, severity: str | None = None, package: str | None = None) -> DataFrame:
    """Actionables of a category, severity and package; an unknown package is an error."""
    if package is not None and actionables.where(F.col("package") == package).isEmpty():
        raise ValueError(f"unknown package: {package}")
    for name, value in (("category", category), ("severity", severity), ("package", package)):
        if value is not None:
            actionables = actionables.where(F.col(name) == value)
    return actionables


def selected(asked: DataFrame, own: DataFrame) -> DataFrame:
    """Which package of a workspace is scanned, and how it was found: the one asked for, else the root, else the only one; else the caller is asked.

    asked(workspace, wanted), own(workspace, package, root).
    """
    told = asked.join(own, "workspace", "left").groupBy("workspace").agg(
        F.max(F.when(F.col("package") == F.col("wanted"), F.col("package"))).alias("hit"), F.min(F.when(F.col("root"), F.col("package"))).alias("top"), F.count("package").alias("n"), F.min("package").alias("one")
    )
    hit, top, only = F.col("hit").isNotNull(), F.col("top").isNotNull(), F.col("n") == 1
    package = F.when(hit, F.col("hit")).when(top, F.col("top")).when(only, F.col("one"))
    return told.select("workspace", package.alias("package"), F.when(hit, "requested").when(top, "root").when(only, "only").when(F.col("n") == 0, "none").otherwise("ask").alias("how"))
