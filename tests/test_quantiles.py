"""Quantiles by rounds of counting are those of sorting."""

import random

import pytest
from pyspark.sql import functions as F

from kinetrack.operators import quantiles as Q


@pytest.mark.parametrize("sent", [100_000, 0])
@pytest.mark.parametrize("bins", [3, 64])
def test_rounds_give_the_percentiles(spark, monkeypatch, sent, bins):
    """Groups of one value, of ties, of far apart values and of halves that repeat, above and below the limit."""
    monkeypatch.setattr(Q, "SENT", sent)
    r = random.Random(bins)
    groups = {
        1: [r.gauss(0, 1) for _ in range(900)],
        2: [5.0] * 300,
        3: [float(r.randrange(3)) for _ in range(500)] + [1e12, -1e12],
        4: [1.0] * 200 + [2.0] * 200,
        5: [r.choice((0.0, 1e-300, 1e300, -1e300)) + r.random() for _ in range(150)],
        6: [3.0, 4.0, None],
        7: [7.0],
        None: [float(k) for k in range(40)],
    }
    df = spark.createDataFrame([(g, x) for g, v in groups.items() for x in v], "recording_id long, area double").repartition(4)
    p = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    want = {x.recording_id: x.q for x in df.where("recording_id is not null").groupBy("recording_id").agg(F.percentile("area", F.array(*map(F.lit, p))).alias("q")).collect()}
    got = {x.recording_id: x.q for x in Q.quantiles(df.where("recording_id is not null"), "area", p, large=100, bins=bins).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    assert Q.quantiles(df.limit(0), "area", p, large=1).count() == 0
