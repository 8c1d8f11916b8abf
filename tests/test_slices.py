"""The tracker over time slices gives what the walk over whole recordings gives, ids included."""

import random

import pytest
from pyspark.sql import functions as F

from kinetrack.operators import slices, tracking

COLUMNS = "recording_id long, frame long, det_id long, x double, y double, width double, height double, degrees_angle double, fps double, frame_count long, illumination double"


def walks(seed, recordings, frames, grid, fps=4.0):
    """Objects that jitter, pause and vanish; ``grid`` makes equal distances likely."""
    r, rows = random.Random(seed), []
    for rec in range(recordings):
        count = r.choice([None, frames + 15])
        objects = [[r.uniform(0, 200), r.uniform(0, 200), 0] for _ in range(r.randint(2, 8))]
        for f in range(r.choice([0, 3]), frames):
            if r.random() < 0.05:
                objects.append([r.uniform(0, 200), r.uniform(0, 200), 0])
            if r.random() < 0.04 and objects:
                objects.pop(r.randrange(len(objects)))
            if 90 < f < 90 + 3 * rec:  # a pause in which all expire
                continue
            k = 0
            for o in objects:
                o[0], o[1] = o[0] + r.uniform(-6, 6), o[1] + r.uniform(-6, 6)
                o[2] = o[2] - 1 if o[2] else (r.randint(1, 6) if r.random() < 0.03 else 0)
                if not o[2]:
                    x, y = (float(round(o[0] / grid) * grid), float(round(o[1] / grid) * grid)) if grid else (o[0], o[1])
                    rows.append((rec, f, k, x, y, 2.0, 3.0, 10.0, fps, count, float(r.randrange(3))))
                    k += 1
    return rows


@pytest.mark.parametrize(("seed", "grid", "luminosity", "length"), [(1, 0, False, 20), (2, 8, False, 25), (3, 20, False, 9), (4, 0, True, 40), (5, 4, True, 16)])
def test_slices_give_what_whole_recordings_give(spark, seed, grid, luminosity, length):
    df = spark.createDataFrame(walks(seed, 4, 160, grid), COLUMNS).orderBy(F.rand(3)).repartition(3)
    want = sorted(map(tuple, tracking.track(df, luminosity=luminosity).collect()))
    got = slices.track_in_slices(df, length, luminosity=luminosity)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 1000


def test_slices_of_nothing_and_of_one_frame(spark):
    df = spark.createDataFrame(walks(9, 1, 1, 0), COLUMNS)
    assert sorted(map(tuple, slices.track_in_slices(df, 10).collect())) == sorted(map(tuple, tracking.track(df).collect()))
    assert slices.track_in_slices(df.limit(0), 10).count() == 0


def test_rounds_do_not_read_the_detections_again(spark):
    rows = walks(3, 2, 160, 20)
    read = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            read.add(len(part))
            yield part

    df = spark.createDataFrame(rows, COLUMNS).mapInPandas(counted, COLUMNS)
    slices.track_in_slices(df, 9).count()
    assert read.value <= 2 * len(rows)  # once for the recordings' ends, once for the slices
