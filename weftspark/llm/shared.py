"""Tables between the steps of an operator, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_MADE: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; only where none is set (tests), a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="weft-checkpoints-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the driver's process ends."""
    path = f"{shared_root(spark)}/weft-{uuid.uuid4().hex}/{name}"
    _MADE[path] = spark
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _MADE.pop(path, None)


@atexit.register
def _clean() -> None:
    for path, spark in list(_MADE.items()):
        try:
            if spark.sparkContext._jsc is not None:
                delete_path(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            return


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write a step's rows to the shared folder and read them again: later steps neither repeat the work nor lose it with an executor.

    ``batch_rows`` bounds the rows of an Arrow batch in this step, where the session allows more.
    """
    spark = df.sparkSession
    path, before = work_path(spark, name), spark.conf.get(ARROW_ROWS)
    fewer = batch_rows is not None and not 0 < int(before) <= batch_rows
    if fewer:
        spark.conf.set(ARROW_ROWS, batch_rows)
    try:
        df.write.parquet(path)
    finally:
        if fewer:
            spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have, in any letter case."""
    held = {c.lower() for c in df.columns}
    while f"_{name}" in held:
        name = f"_{name}"
    return f"_{name}"


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint for a side whose counted rows are few; beyond the limit Spark shuffles both sides."""
    return F.broadcast(df) if rows <= limit else df
