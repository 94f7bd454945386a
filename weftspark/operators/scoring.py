"""Deterministic checks over pages: findings, category scores, grades, ranked work.

A check is a row of the catalog and a predicate column. Findings are one row a
page and check; everything after that is aggregation over findings, so any other
source of findings with these columns scores the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Category weights, grade floors, and order of priorities.
CATEGORY_WEIGHTS = {"accessibility": 20, "forms": 10, "foundation": 20, "interaction": 20, "production-polish": 10, "states": 20}
GRADE_FLOORS = (("A", 90), ("B", 80), ("C", 70), ("D", 60))
PRIORITIES = ("P0", "P1", "P2")

#: id, category, severity, confidence, most points, work group, predicate in SQL that both engines read; null is "does not apply".
PAGE_CHECKS = (
    ("url-secure", "foundation", "error", "high", 10, "transport", "left(url, 8) = 'https://'"),
    ("url-without-tracking", "foundation", "warning", "high", 5, "addresses", "NOT contains(url, 'utm_')"),
    ("url-without-fragment", "foundation", "warning", "medium", 5, "addresses", "NOT contains(url, '#')"),
    ("page-language", "accessibility", "error", "high", 10, None, "contains(html, '<html lang=')"),
    ("entities-absent", "accessibility", "warning", "medium", 5, None, "NOT contains(html, '&amp;')"),
    ("paragraphs-few", "interaction", "warning", "high", 10, "length", "length(html) - length(replace(html, '<p>', '')) <= 30"),
    ("page-short", "production-polish", "warning", "high", 10, "length", "length(html) >= 3000"),
    ("main-host", "states", "error", "medium", 10, None, "NOT contains(url, '://m.')"),
    ("title-close", "states", "warning", "low", 5, None, "NOT contains(url, '.html')"),
    ("query-described", "production-polish", "info", "high", 5, None, "CASE WHEN contains(url, '?') THEN contains(url, 'page=') END"),
)


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*c[:4], float(c[4]), c[5]) for c in PAGE_CHECKS], "id string, category string, severity string, confidence string, most double, work_group string")


def page_results(pages: DataFrame) -> DataFrame:
    """page_id, host, id and passed (null: does not apply); one pass over the pages makes all checks."""
    results = F.array(*(F.struct(F.lit(c[0]).alias("id"), F.expr(c[6]).alias("passed")) for c in PAGE_CHECKS))
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return pages.select("page_id", host.alias("host"), F.explode(results).alias("r")).select("page_id", "host", "r.id", "r.passed")


def findings(results: DataFrame, rules: DataFrame) -> DataFrame:
    """Results with their check's traits: a failing check of low confidence is an advisory, which keeps its points and has no impact."""
    joined = results.join(F.broadcast(rules), "id")
    status = F.when(F.col("passed").isNull(), "not-applicable").when(F.col("passed"), "pass").when(F.col("confidence") == "low", "advisory").otherwise("fail")
    out = joined.withColumn("status", status)
    most = F.when(F.col("status") == "not-applicable", 0.0).otherwise(F.col("most"))
    return out.withColumns({
        "impacts_score": (F.col("most") > 0) & ~F.col("status").isin("advisory", "not-applicable"),
        "score": F.when(F.col("status").isin("pass", "advisory"), most).otherwise(F.lit(0.0)),
        "most": most,
    })


def category_scores(found: DataFrame, key: str) -> DataFrame:
    """For each key and every category: ratio of points reached, null where nothing applies, and the weight."""
    weights = found.sparkSession.createDataFrame(list(CATEGORY_WEIGHTS.items()), "category string, weight int")
    sums = found.where("impacts_score").groupBy(key, "category").agg(F.sum("score").alias("raw"), F.sum("most").alias("raw_most"))
    every = found.select(key).distinct().crossJoin(F.broadcast(weights))
    ratio = F.col("raw") / F.nullif(F.col("raw_most"), F.lit(0.0))
    return every.join(sums, [key, "category"], "left").select(key, "category", "weight", ratio.alias("ratio"))


def grade(score: Column) -> Column:
    out = F.when(score.isNull(), None)
    for name, floor in GRADE_FLOORS:
        out = out.when(score >= floor, name)
    return out.otherwise("F")


def total_scores(categories: DataFrame, key: str) -> DataFrame:
    """Weighted score of the categories that apply, rounded half up, and its grade."""
    applies = F.when(F.col("ratio").isNotNull(), F.col("weight"))
    sums = categories.groupBy(key).agg(F.sum(F.col("ratio") * F.col("weight")).alias("reached"), F.sum(applies).alias("weights"))
    score = F.floor(100 * F.col("reached") / F.nullif(F.col("weights"), F.lit(0)) + 0.5)
    return sums.select(key, score.alias("score")).withColumn("grade", grade(F.col("score")))


def actionables(found: DataFrame) -> DataFrame:
    """Failing and advisory findings with priority, disposition and the points to win."""
    priority = F.when((F.col("severity") == "error") & (F.col("status") == "fail"), "P0").when((F.col("status") == "fail") & (F.col("confidence") == "high"), "P1").otherwise("P2")
    disposition = F.when(F.col("status") == "advisory", "verify").otherwise("fix")
    impact = F.when(F.col("impacts_score"), F.col("most") - F.col("score")).otherwise(F.lit(0.0))
    return found.where(F.col("status").isin("fail", "advisory")).withColumns({"priority": priority, "disposition": disposition, "impact": impact})


def work_items(found: DataFrame) -> DataFrame:
    """Actionables of a page grouped by work group where two or more fall in one: first priority, summed impact, ordered categories."""
    return (
        found.where("work_group is not null")
        .groupBy("page_id", "work_group")
        .agg(F.min("priority").alias("priority"), F.min("disposition").alias("disposition"), F.sum("impact").alias("impact"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
        .where("n >= 2")
    )
