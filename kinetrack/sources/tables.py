"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

#: Rows of a task, where rows of tracks are dealt out.
TASK_ROWS = 250_000


def scratch(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``; where a local session names none, below a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/kinetrack-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table and read it back: what several later steps read is computed once, and lineage ends there."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(table: DataFrame, *keys: str | Column) -> DataFrame:
    """The rows of ``table``, as it is stored, dealt by ``keys`` over tasks of about ``TASK_ROWS`` rows.

    Windows, sums and joins by these keys, or by more, then need no exchange, and what a task holds does not grow with
    the table. Counting reads no column.
    """
    tasks = max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // TASK_ROWS))
    return table.repartition(tasks, *keys)
