"""Exact quantiles of groups of any size, without a task that sees all values of one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: Values of a group up to which one task sorts them; parts into which an interval is cut in each round.
LARGE, BINS = 1_000_000, 4096
#: Intervals up to which they are sent to all tasks (32 bytes each); beyond, they meet the values in a salted join.
SENT, SALTS = 100_000, 32


def _counted(rows: DataFrame, by: str, value: str, intervals: DataFrame, sent: bool, bins: int) -> DataFrame:
    """Values inside each interval by equal parts of it: how many, the least and the greatest, and how many lie before."""
    if sent:
        inside = rows.join(F.broadcast(intervals), by)
    else:
        salted = intervals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        inside = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, [by, "salt"]).drop("salt")
    inside = inside.where(F.col(value).between(F.col("lo"), F.col("hi")))
    part = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    found = inside.groupBy(by, "lo", "hi", part.alias("part")).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
    before = Window.partitionBy(by, "lo", "hi").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def quantiles(rows: DataFrame, value: str, probabilities: Sequence[float], by: str = "recording_id", large: int = LARGE, bins: int = BINS) -> DataFrame:
    """``by, q``: the values at ``probabilities`` of each group, in between two values by the straight line, as ``percentile`` gives them.

    Groups of up to ``large`` values are sorted. In larger ones each wanted rank has an interval that holds it, at first
    from the least value to the greatest. Every round counts the values in ``bins`` parts of the interval over all
    partitions and narrows it to the least and the greatest value of the part with the rank, until both are one value:
    a round or two more than it takes to get from the number of values to one in steps of ``bins``, whatever repeats.
    ``rows`` are read in each round, so they should be a table. NULL values do not count, nor
    do rows without a group where some group is large.
    """
    rows = rows.select(by, F.col(value).cast("double").alias("v")).where("v is not null")
    sizes = written(rows.groupBy(by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    found = F.percentile("v", F.array(*[F.lit(float(p)) for p in probabilities])).alias("q")
    if sizes.where(F.col("n") > large).isEmpty():
        return rows.groupBy(by).agg(found)
    sorted_ = rows.join(sizes.where(F.col("n") <= large).select(by), by, "left_semi").groupBy(by).agg(found)
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probabilities)]))
    targets = sizes.where(F.col("n") > large).withColumn("w", wanted).withColumn("at", (F.col("n") - 1) * F.col("w.p"))
    ends = F.explode(F.array(F.struct(F.floor("at").alias("rank"), F.lit(False).alias("upper")), F.struct(F.ceil("at").alias("rank"), F.lit(True).alias("upper"))))
    targets = written(targets.select(by, "w.i", "at", "lo", "hi", ends.alias("e")).select(by, "i", "at", "e.upper", F.col("e.rank").cast("long").alias("rank"), "lo", "hi"))
    while True:
        open_ = targets.where("lo < hi")
        intervals = open_.select(by, "lo", "hi").distinct()
        n = intervals.count()
        if not n:
            break
        parts = _counted(rows, by, "v", intervals, n <= SENT, bins)
        narrowed = open_.join(parts, [by, "lo", "hi"]).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
        narrowed = narrowed.select(by, "i", "at", "upper", (F.col("rank") - F.col("before")).alias("rank"), F.col("least").alias("lo"), F.col("most").alias("hi"))
        targets = written(targets.where("lo = hi").unionByName(narrowed))
    pair = targets.groupBy(by, "i").agg(F.max(F.when(~F.col("upper"), F.col("lo"))).alias("a"), F.max(F.when(F.col("upper"), F.col("lo"))).alias("b"), F.first("at").alias("at"))
    between = F.col("a") + (F.col("at") - F.floor("at")) * (F.col("b") - F.col("a"))
    both = pair.select(by, F.struct("i", between.alias("x")).alias("x")).groupBy(by).agg(F.transform(F.array_sort(F.collect_list("x")), lambda s: s["x"]).alias("q"))
    return sorted_.unionByName(both)
