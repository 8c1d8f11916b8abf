"""Evaluation: motion features of every row and statistics of every track."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import WT, W, binary_median, binary_median_within, delta, fold_angle, heading_deg, lag_within, local_max, safe_ratio, since_first, step, to_um
from ..schemas import ANALYSED_COLUMNS, KEY
from ..settings import Settings
from ..sources.tables import dealt, written

MOVING_UM_PER_FRAME = 1e-3
RATIO_MOTILE, RUN_MOTILE = 1.5, 5
OUTSIDE = 0.7


def steps(df: DataFrame, s: Settings) -> DataFrame:
    """Lengths in micrometres, steps, and the raw moving flag."""
    out = df.withColumns({"width": to_um("width", s.px_per_um), "height": to_um("height", s.px_per_um)})
    out = out.withColumns({"row_number": F.row_number().over(W()), "dx": delta("position_x", 0.0), "dy": delta("position_y", 0.0), "dt": delta("position_t", 1), "t_norm": since_first("position_t")})
    out = out.withColumns({"travelled_dist": to_um(step(F.col("dx"), F.col("dy")), s.px_per_um), "bac_length": F.greatest("width", "height")})
    out = out.withColumns({"x_norm": to_um(since_first("position_x"), s.px_per_um), "y_norm": to_um(since_first("position_y"), s.px_per_um)})
    return out.withColumn("moving_raw", (F.col("travelled_dist") / F.col("dt") > MOVING_UM_PER_FRAME).cast("int"))


def moving(df: DataFrame) -> DataFrame:
    """The moving flag after a median filter of three rows and one of about a second at each row's ``fps``."""
    half = F.floor(F.bround("fps") / 2)  # of the rounded rate, made odd
    return df.withColumn("moving", binary_median("moving_raw", 3)).withColumn("moving", binary_median_within("moving", half))


def headings(df: DataFrame, s: Settings) -> DataFrame:
    """Heading over several rows (radians and degrees) and its change in whole degrees."""
    n = s.angle_rows
    dx, dy = F.col("position_x") - F.lag("position_x", n).over(W()), F.col("position_y") - F.lag("position_y", n).over(W())
    out = df.withColumns({"heading": F.atan2(dx, dy), "heading_deg": heading_deg(dx, dy)})
    change = F.abs(F.col("heading_deg") - F.lag("heading_deg").over(W()))
    # Rounded before the cut, so that a whole angle does not depend on the last digit of the platform's arctangent.
    return out.withColumn("angle_diff", F.round(fold_angle(F.coalesce(change, F.lit(0.0))), 9).cast("int"))


def turns(df: DataFrame, s: Settings) -> DataFrame:
    """Turning points: local maxima of large enough heading changes while moving; the first row always counts."""
    out = df.withColumn("turn_candidate", F.when((F.col("angle_diff") > s.minimal_angle) & (F.col("moving") == 1), F.col("angle_diff")).otherwise(0))
    out = out.withColumn("turn_points", local_max("turn_candidate"))
    return out.withColumn("turn_points", F.when(F.col("row_number") == 1, 1).otherwise(F.col("turn_points")))


def runs(df: DataFrame) -> DataFrame:
    """Runs between turning points (NULL while still) and the path of each run."""
    begins = (F.col("turn_points") == 1) & (F.coalesce(F.lag("turn_points").over(W()), F.lit(0)) == 0)
    out = df.withColumn("tp_of_tracks", F.when(F.col("moving") == 1, F.sum(begins.cast("long")).over(W())))
    path = F.sum("travelled_dist").over(Window.partitionBy(*KEY, "tp_of_tracks"))
    return out.withColumn("run_distance", F.when(F.col("tp_of_tracks").isNotNull(), path))


def motility(df: DataFrame, s: Settings) -> DataFrame:
    """Displacement over a lag, longest run, both by mean cell length, the phenotype, and the final turning points."""
    n = F.bround(F.col("fps") * s.lag_seconds)
    far = to_um(step(F.col("position_x") - lag_within("position_x", n), F.col("position_y") - lag_within("position_y", n)), s.px_per_um)
    out = df.withColumn("lag_displacement", far)
    mean = F.avg("bac_length").over(WT())
    out = out.withColumns({"displacement_ratio": F.max("lag_displacement").over(WT()) / mean, "run_ratio": F.max("run_distance").over(WT()) / mean})
    far_enough = F.col("displacement_ratio") > RATIO_MOTILE
    phenotype = F.when(far_enough & (F.col("run_ratio") > RUN_MOTILE), 2).when(far_enough & (F.col("run_ratio") <= RUN_MOTILE), 1).otherwise(0)
    out = out.withColumn("motility_phenotype", phenotype)
    points = F.when(F.col("row_number") == 1, 1).when(F.col("motility_phenotype") == 0, 0).otherwise(F.col("turn_points"))
    return out.withColumn("turn_points", points)


def features(df: DataFrame, s: Settings) -> DataFrame:
    """All per-row features, at any number of frame rates in one pass.

    ``df`` has the columns of ``tracks`` and ``fps``; where that is NULL or not above 0, the settings' rate holds.
    """
    rate = F.when(F.col("fps") > 0, F.col("fps")).otherwise(F.lit(float(s.fps)))
    return motility(runs(turns(headings(moving(steps(df.withColumn("fps", rate), s)), s), s)), s)


def analysed(found: DataFrame) -> DataFrame:
    return found.select(*ANALYSED_COLUMNS)


def recording_row_index(df: DataFrame) -> DataFrame:
    """Add ``row_index``, the row's number in its recording by track and time, from the tracks' row counts."""
    sizes = df.groupBy(*KEY).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("recording_id").orderBy("track_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.join(sizes.select(*KEY, before.alias("before")), KEY).withColumn("row_index", F.col("before") + F.row_number().over(W()) - 1).drop("before")


def median_speed(found: DataFrame, aligned: str = "recording") -> DataFrame:
    """Median over a track's one-second bins of the path in the bin; bins count rows from the recording's or the track's start."""
    rows = recording_row_index(found) if aligned == "recording" else found.withColumn("row_index", F.row_number().over(W()) - 1)
    sums = rows.groupBy(*KEY, F.floor(F.col("row_index") / F.col("fps")).alias("bin")).agg(F.sum("travelled_dist").alias("path"))
    return sums.groupBy(*KEY).agg(F.median("path").alias("median_speed"))


def hull(p: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points, counterclockwise; one or two where they are one point or on a line."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p
    points = p.tolist()

    def chain(order: list[list[float]]) -> list[list[float]]:
        out: list[list[float]] = []
        for x, y in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append([x, y])
        return out

    return np.array(chain(points)[:-1] + chain(points[::-1])[:-1])


def diameter(corners: np.ndarray) -> float:
    """The largest distance between two corners of a convex hull, by two parallel lines that turn around it."""
    n, c = len(corners), corners.tolist()
    if n < 3:
        return float(np.hypot(*(corners[-1] - corners[0]))) if n else 0.0
    cross = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    best, far = 0.0, 1
    for i in range(n):
        a, b = c[i], c[(i + 1) % n]
        while cross(a, b, c[(far + 1) % n]) > cross(a, b, c[far]):
            far = (far + 1) % n
        for p in (c[far], c[(far + 1) % n]):  # parallel sides have both ends of the far one
            for q in (a, b):
                best = max(best, (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2)
    return best**0.5


def hull_diameter(x: np.ndarray, y: np.ndarray) -> float:
    """The largest distance between two points, by way of the convex hull."""
    return diameter(hull(np.stack([x, y], axis=1)))


def _part_hulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch the corners of each track's hull."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in KEY])
        at = np.stack([batch.column(c).to_numpy() for c in ("x_norm", "y_norm")], axis=1)
        order = np.lexsort(key[::-1])
        key, at = key[:, order], at[order]
        begin = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
        hulls = [hull(at[a:b]) for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(at)], strict=True)]
        of, corners = np.repeat(begin, [len(h) for h in hulls]), np.concatenate(hulls)
        yield pa.record_batch([pa.array(key[0, of]), pa.array(key[1, of]), pa.array(corners[:, 0]), pa.array(corners[:, 1])], names=[*KEY, "x_norm", "y_norm"])


def max_displacement(found: DataFrame) -> DataFrame:
    """Largest distance between any two positions of a track (``x_norm``, ``y_norm``); 0 for a single row.

    Each batch of rows is reduced to the hulls of its tracks where it lies; only their corners are shuffled and meet.
    """

    def run(table: pa.Table) -> pa.Table:
        d = hull_diameter(table.column("x_norm").to_numpy(), table.column("y_norm").to_numpy())
        return pa.table({**{k: table.column(k).slice(0, 1) for k in KEY}, "displacement_um": pa.array([d], pa.float64())})

    corners = found.select(*KEY, "x_norm", "y_norm").mapInArrow(_part_hulls, "recording_id long, track_id long, x_norm double, y_norm double")
    return dealt(written(corners), *KEY).groupBy(*KEY).applyInArrow(run, "recording_id long, track_id long, displacement_um double")


def track_stats(found: DataFrame, aligned: str = "recording") -> DataFrame:
    """The statistics of each track. The features are written once and dealt by track, as sums, hulls and medians all read them."""
    found = dealt(written(found.select(*KEY, "position_t", "t_norm", "moving", "travelled_dist", "bac_length", "turn_points", "x_norm", "y_norm", "motility_phenotype", "fps")), *KEY)
    last = lambda c: F.max_by(c, "position_t")
    g = found.groupBy(*KEY).agg(
        F.max("t_norm").alias("t"),
        F.sum("moving").alias("m"),
        F.sum("travelled_dist").alias("d"),
        F.avg("bac_length").alias("l"),
        F.sum("turn_points").alias("tp"),
        last(F.struct("x_norm", "y_norm")).alias("end"),
        last("motility_phenotype").alias("motility_phenotype"),
        F.max("fps").alias("fps"),
    )
    g = g.join(max_displacement(found), KEY).join(median_speed(found, aligned), KEY)
    time = (F.col("t") + 1) / F.col("fps")
    still = F.col("m") == 0
    return g.select(
        *KEY,
        F.when(still, 0.0).otherwise((F.col("tp") - 1) * F.col("fps") / F.col("m")).alias("turn_points_per_s"),
        F.col("d").alias("distance_um"),
        F.when(still, 0.0).otherwise(F.col("d") / time).alias("speed_um_s"),
        time.alias("time_s"),
        "displacement_um",
        (F.col("m") / (F.col("t") + 1) * 100).alias("perc_motile"),
        safe_ratio(step(F.col("end.x_norm"), F.col("end.y_norm")), F.col("d")).alias("arc_chord_ratio"),
        F.col("l").alias("bac_length_um"),
        safe_ratio(F.col("displacement_um"), F.col("l")).alias("displacement_by_length"),
        "motility_phenotype",
        "median_speed",
    )


def angle_histogram(found: DataFrame, bins: int = 36) -> DataFrame:
    """Headings of moving rows of tracks that mostly move, in equal bins from -pi to pi, empty bins included."""
    rows = found.withColumn("share", F.avg("moving").over(WT())).where((F.col("share") > OUTSIDE) & (F.col("moving") == 1))
    width = 2 * np.pi / bins
    spot = F.least(F.floor((F.col("heading") + np.pi) / width), F.lit(bins - 1)).cast("int")
    counts = rows.where("heading is not null").groupBy("recording_id", spot.alias("bin")).agg(F.count("*").alias("n"))
    chosen = rows.groupBy("recording_id").agg(F.count("*").alias("rows_selected"))
    every = chosen.select("recording_id", "rows_selected", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, ["recording_id", "bin"], "left").select("recording_id", "bin", F.coalesce("n", F.lit(0)).alias("n"), "rows_selected")
