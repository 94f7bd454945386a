"""Session settings shared by the queries, the tests and the bench."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "weftspark", cores: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings that every query here assumes."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores or os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("WEFT_DRIVER_MEMORY", "6g"))
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
