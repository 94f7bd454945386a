"""Job and cache tables: read models, lapses, purges and claim decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def read_model(jobs: DataFrame, access: DataFrame, cache: DataFrame, now: str) -> DataFrame:
    """Jobs seen through a token, with the state that expiry and the live cache row give them."""
    live = cache.where(F.col("cache_expires") > F.lit(now).cast("timestamp")).select("cache_key", F.lit(True).alias("hit"))
    seen = jobs.join(access, "job_id").join(live, "cache_key", "left")
    state = F.when(F.col("expires") <= F.lit(now).cast("timestamp"), "expired").when(F.col("hit"), "completed").when(F.col("state") == "completed", "lapsed").otherwise(F.col("state"))
    return seen.select("job_id", "token", state.alias("shown_state"))


def oldest_expired(rows: DataFrame, expires: str, key: str, now: str, most: int) -> DataFrame:
    """The bounded purge: the ``most`` oldest rows at or past their expiry (top-k without a full sort)."""
    return rows.where(F.col(expires) <= F.lit(now).cast("timestamp")).orderBy(expires, key).limit(most)


def claims(jobs: DataFrame, most_attempts: int, cap: int, now: str) -> DataFrame:
    """The first matching line of the claim table for each job; jobs has expires, hit, state, lease, attempts."""
    at = F.lit(now).cast("timestamp")
    leased = (F.col("state") == "running") & (F.col("lease") > at)
    # Other active leases: all of them without the job's own.
    active = jobs.agg(F.count_if(leased).alias("active"))
    rows = jobs.crossJoin(F.broadcast(active)).withColumn("others", F.col("active") - leased.cast("int"))
    decision = (
        F.when(F.col("expires") <= at, "expired").when(F.col("hit"), "completed").when(F.col("state").isin("failed", "completed"), "terminal")
        .when(leased, "busy").when(F.col("attempts") >= most_attempts, "exhausted").when(F.col("others") >= cap, "busy").otherwise("claimed")
    )
    return rows.select("job_id", decision.alias("decision"), F.when(decision == "claimed", F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts_after"))


def capped(rows: DataFrame, kind: str, order: str, most: int) -> DataFrame:
    """The first rows of each kind and how many of the kind were left out."""
    by = Window.partitionBy(kind)
    return rows.withColumn("place", F.row_number().over(by.orderBy(order))).withColumn("dropped", F.greatest(F.count("*").over(by) - most, F.lit(0))).where(F.col("place") <= most)
