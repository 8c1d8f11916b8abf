"""Intermediate tables and small Spark helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; where a local session names none, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a unique long ``name`` for each row. The table is written, so that every reader sees the same numbers."""
    return written(df.withColumn(name, F.monotonically_increasing_id()))


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def min_label(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Connected components by hooking and pointer jumping.

    ``edges`` has long columns ``a`` and ``b``. Returns ``node, label`` for every node of an edge (and of
    ``nodes``); ``label`` is the smallest node of its component. Every round moves each root to the
    smallest label that its members see and then shortcuts, so the rounds grow with the logarithm of
    the diameter. Messages to a hot node are reduced by ``min`` before the shuffle.
    """
    e = written(edges.select("a", "b").where("a <> b").distinct())
    ends = e.select(F.col("a").alias("node")).union(e.select(F.col("b").alias("node"))).distinct()
    if nodes is not None:
        ends = ends.union(nodes.select("node")).distinct()
    labels = written(ends.select("node", F.col("node").alias("label")))
    while True:
        la = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        lb = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        crossing = written(e.join(la, "a").join(lb, "b").where("la <> lb").select("la", "lb").distinct())
        if crossing.isEmpty():
            return labels
        # Each root hooks to its smallest neighbouring root below it; chains are then followed to their end.
        hook = crossing.select(F.greatest("la", "lb").alias("root"), F.least("la", "lb").alias("to"))
        hook = written(hook.groupBy("root").agg(F.min("to").alias("to")))
        while True:
            nxt = hook.select(F.col("root").alias("to"), F.col("to").alias("next"))
            step = written(hook.join(nxt, "to", "left").select("root", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
            hook = step.select("root", "to")
            if step.where("moved").isEmpty():
                break
        moved = labels.join(hook, labels["label"] == hook["root"], "left")
        labels = written(moved.select("node", F.coalesce("to", "label").alias("label")))


def chunks(lengths: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows that hold about ``limit`` bytes; a longer row is a range of its own."""
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)
