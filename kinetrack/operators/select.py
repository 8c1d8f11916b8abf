"""Selection: from raw tracks to the trustworthy fragment of each track."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import WT, W, area, side_ratio, step
from ..schemas import KEY, TRACK_COLUMNS
from ..settings import Settings
from ..sources.tables import written
from .quantiles import quantiles


def with_recording(df: DataFrame, recordings: DataFrame, s: Settings) -> DataFrame:
    """Attach fps and frame size; the settings stand in for what is missing, for height and width together.

    ``recordings`` has one short row per recording and is sent to all tasks, so rows stay dealt as they are.
    """
    fps = F.when((F.col("fps") > 0) & F.lit(not s.force_fps), F.col("fps")).otherwise(F.lit(float(s.fps)))
    both = F.col("frame_height").isNotNull() & F.col("frame_width").isNotNull()
    r = recordings.select(
        "recording_id",
        fps.alias("fps"),
        F.when(both, F.col("frame_height")).otherwise(s.frame_height).alias("frame_height"),
        F.when(both, F.col("frame_width")).otherwise(s.frame_width).alias("frame_width"),
    )
    out = df.join(F.broadcast(r), "recording_id", "left")
    missing = {"fps": float(s.fps), "frame_height": s.frame_height, "frame_width": s.frame_width}
    return out.fillna(missing)


def min_rows(s: Settings) -> Column:
    """Whole frames of the minimal length at each recording's rate (rounded half to even)."""
    return F.floor(F.lit(s.minimal_length_s) * F.bround("fps"))


def sort_tracks(df: DataFrame) -> DataFrame:
    """Rows by recording, track and time."""
    return df.orderBy(*KEY, "position_t")


def guard_recordings(df: DataFrame, s: Settings) -> DataFrame:
    """Drop recordings with fewer rows than the minimal length. ``df`` has ``fps``."""
    enough = df.groupBy("recording_id").agg(F.count("*").alias("n"), F.max("fps").alias("fps")).where(F.col("n") >= min_rows(s))
    return df.join(enough.select("recording_id"), "recording_id", "left_semi")


def guard_frame_count(recordings: DataFrame, s: Settings) -> DataFrame:
    return recordings.where(F.col("frame_count") >= s.minimal_frame_count)


def with_track_area(df: DataFrame) -> DataFrame:
    """Add ``area``, the track's ``median_area`` and its span of frames ``length``, lost frames included."""
    out = df.withColumn("area", area())
    return out.withColumns({"median_area": F.median("area").over(WT()), "length": F.max("position_t").over(WT()) - F.min("position_t").over(WT()) + 1})


def clean_rows(df: DataFrame, s: Settings) -> DataFrame:
    """Drop small and large tracks, area spikes, lost rows and short tracks, all judged before any is dropped."""
    keep = F.col("median_area").between(s.area_lower, s.area_upper) & (F.col("area") != 0) & (F.col("length") >= min_rows(s))
    if s.area_factor:
        keep &= F.col("area") <= s.area_factor * F.col("median_area")
    return with_track_area(df).where(keep)


def _quantiles(rows: DataFrame, value: str, probabilities: list[float], accuracy: int | None) -> DataFrame:
    """Exact quantiles of each recording, or with ``accuracy`` those of a sketch in one pass."""
    if accuracy:
        return rows.groupBy("recording_id").agg(F.percentile_approx(value, probabilities, accuracy).alias("q"))
    return quantiles(rows, value, probabilities)


def cleaned(df: DataFrame, s: Settings) -> DataFrame:
    """Cleaned rows with steps, of recordings that still have the minimal length. What is too short before is so after."""
    return guard_recordings(written(with_speed(clean_rows(df, s))), s)


def area_bounds(rows: DataFrame, s: Settings, accuracy: int | None = None) -> DataFrame:
    """Area quantiles q and 1 - q of each recording; without a quantile -1 and infinity."""
    q = s.area_quantile_percent / 100
    if not q:
        return rows.select("recording_id").distinct().select("recording_id", F.lit(-1.0).alias("q_lo"), F.lit(float("inf")).alias("q_hi"))
    found = _quantiles(rows, "area", [q, 1 - q], accuracy)
    return found.select("recording_id", F.col("q")[0].alias("q_lo"), F.col("q")[1].alias("q_hi"))


def with_speed(rows: DataFrame) -> DataFrame:
    """Add ``gap`` (frames since the row before, NULL at starts) and ``speed`` (0 at starts)."""
    gap = F.col("position_t") - F.lag("position_t").over(W())
    out = rows.withColumns({"gap": gap, "dx": F.col("position_x") - F.lag("position_x").over(W()), "dy": F.col("position_y") - F.lag("position_y").over(W())})
    return out.withColumn("speed", F.coalesce(step(F.col("dx"), F.col("dy")) / F.col("gap"), F.lit(0.0))).drop("dx", "dy")


def speed_fence(rows: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Per recording: upper quartile plus three times the quartile range of the speed."""
    q = _quantiles(rows, "speed", [0.25, 0.75], accuracy)
    return q.select("recording_id", (F.col("q")[1] + 3 * (F.col("q")[1] - F.col("q")[0])).alias("fence"))


def outlier_switch(rows: DataFrame, fences: DataFrame, s: Settings) -> DataFrame:
    """Per recording: share of rows above the fence, and whether outliers count at all."""
    share = rows.join(fences, "recording_id").groupBy("recording_id").agg(F.avg((F.col("speed") > F.col("fence")).cast("double")).alias("share"), F.first("fence").alias("fence"))
    return share.withColumn("use", (F.col("share") <= s.outlier_stop_percent / 100) & F.lit(s.omit_outliers))


def fragments(rows: DataFrame, s: Settings) -> DataFrame:
    """Cut tracks before rows after large gaps, and at outlier rows, which go.

    ``rows`` has ``gap`` and ``outlier``. Adds ``fragment_id``, and ``hole_id`` for the runs that only
    gaps cut. Splitting goes on until nothing is left to cut, so what survives are the maximal runs; ``limit_depth``
    takes those away that a limited number of nested splits does not reach.
    """
    hole = F.coalesce((F.col("gap") > s.max_holes).cast("int"), F.lit(0))
    out = rows.withColumns({"hole_id": F.sum(hole).over(W()), "fragment_id": F.sum(hole + F.col("outlier").cast("int")).over(W())})
    if s.max_recursion_depth == 0:
        whole = {"hole_id": F.lit(0), "fragment_id": F.when((F.max("hole_id").over(WT()) == 0) & (F.max(F.col("outlier").cast("int")).over(WT()) == 0), 0)}
        out = out.withColumns(whole | {"hole_id": F.when(F.max("hole_id").over(WT()) == 0, 0)})
    return out


def _depths(gaps: np.ndarray, hole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many nested splits lead to each fragment of a track, and to the run between gaps in which it lies.

    ``gaps`` has the gap before each row where the track is cut, ``hole`` says whether that is too large; the others
    are outliers. A part is first split at its largest gap, the earliest on ties; without gaps at its first outlier.
    So the gaps that lead to a run are those that no gap between them and the run exceeds: found on either side by a
    stack of gaps.
    """
    sizes = gaps[hole].tolist()
    left, right = [0], [0]
    for found, order, gives_way in ((left, sizes, lambda a, b: a < b), (right, sizes[::-1], lambda a, b: a <= b)):
        stack: list[float] = []
        for g in order:
            while stack and gives_way(stack[-1], g):
                stack.pop()
            stack.append(g)
            found.append(len(stack))
    runs = np.array(left) + np.array(right[::-1])
    run = np.concatenate([[0], np.cumsum(hole)])
    first = np.concatenate([[0], np.flatnonzero(hole) + 1])
    nth = np.arange(len(run)) - first[run]
    outliers = np.diff(np.append(first, len(run))) - 1
    return runs[run] + np.minimum(nth + 1, outliers[run]), runs[run]


def limit_depth(cut: DataFrame, s: Settings) -> DataFrame:
    """Take the ids of fragments and runs away to which more than ``max_recursion_depth`` nested splits lead.

    A track with as many cuts or fewer has none, so only the cuts of other tracks are looked at. ``cut`` should be a table.
    """
    limit = s.max_recursion_depth
    deep = cut.where(F.col("track_cuts") > limit)
    if limit == 0 or deep.isEmpty():
        return cut

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("position_t")
        hole = table.column("hole").to_numpy()
        outlier = table.column("outlier").to_numpy()
        # A row may be both: the gap cuts before it, and then it goes.
        row = np.repeat(np.arange(len(hole)), hole.astype(int) + outlier)
        second = np.append(False, row[1:] == row[:-1]) if len(row) else np.zeros(0, bool)
        depth, runs = _depths(table.column("gap").fill_null(0).to_numpy()[row], hole[row] & ~second)
        n = len(depth)
        columns = [table.column(c).take(pa.array(np.zeros(n, np.int64))) for c in KEY]
        return pa.table([*columns, pa.array(np.arange(n)), pa.array(depth), pa.array(runs)], names=[*KEY, "fragment_id", "depth", "run_depth"])

    hole = F.coalesce(F.col("gap") > s.max_holes, F.lit(False))
    cuts = deep.where(hole | F.col("outlier")).select(*KEY, "position_t", "gap", hole.alias("hole"), "outlier")
    depths = cuts.groupBy(*KEY).applyInArrow(run, "recording_id long, track_id long, fragment_id long, depth long, run_depth long")
    out = cut.join(depths, [*KEY, "fragment_id"], "left")
    kept = {"hole_id": F.when(F.coalesce("run_depth", F.lit(0)) <= limit, F.col("hole_id")), "fragment_id": F.when(F.coalesce("depth", F.lit(0)) <= limit, F.col("fragment_id"))}
    return out.withColumns(kept).select(*cut.columns)


def fragment_profile(cut: DataFrame, s: Settings) -> DataFrame:
    """Measures of each fragment and its reject reason (0: accepted), given the recording's area quantiles."""
    inside = cut.where(~F.col("outlier") & F.col("fragment_id").isNotNull())
    out = inside.groupBy(*KEY, "fragment_id").agg(
        F.count("*").alias("n_rows"),
        F.min("position_t").alias("start_t"),
        F.max("position_t").alias("stop_t"),
        F.avg("area").alias("avg_area"),
        F.avg(side_ratio()).alias("avg_ratio"),
        *[f(f"position_{a}").alias(f"{n}_{a}") for a in "xy" for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))],
        *[F.first(c).alias(c) for c in ("fps", "frame_height", "frame_width", "q_lo", "q_hi", "track_rows", "track_cuts")],
    )
    return out.withColumn("reason", fragment_reason(s))


def fragment_reason(s: Settings) -> Column:
    lo, hi = s.ratios
    margin = s.edge_percent / 100
    out = F.lit(0)
    if margin:
        inside = lambda c, size: (F.col(c) > F.col(size) * margin) & (F.col(c) < F.col(size) * (1 - margin))
        box = (F.col("min_x") >= 0) & (F.col("max_x") <= F.col("frame_width")) & (F.col("min_y") >= 0) & (F.col("max_y") <= F.col("frame_height"))
        out = F.when(~(inside("avg_y", "frame_height") & inside("avg_x", "frame_width")), 2).when(~box, 1).otherwise(out)
    span = F.col("stop_t") - F.col("start_t") + 1
    return (
        F.when(~(span / F.col("n_rows") < s.max_empty_percent / 100 + 1), 5)
        .when(~F.col("avg_area").between(F.col("q_lo"), F.col("q_hi")), 4)
        .when(~((F.col("avg_ratio") > lo) & (F.col("avg_ratio") < hi)), 3)
        .otherwise(out)
    )


def cut_tracks(df: DataFrame, s: Settings, accuracy: int | None = None) -> DataFrame:
    """Cleaned rows with area bounds, outlier flags and fragment ids. ``df`` has fps and frame size."""
    # Bounds, fences, shares and the cut itself read the cleaned rows, so they are written once.
    rows = cleaned(df, s)
    bounds = area_bounds(rows, s, accuracy).join(outlier_switch(rows, speed_fence(rows, accuracy), s), "recording_id")
    rows = rows.join(bounds, "recording_id")
    rows = rows.withColumn("outlier", F.col("use") & (F.col("speed") > F.col("fence")))
    rows = fragments(rows, s)
    cuts = F.max(F.coalesce("fragment_id", F.lit(1))).over(WT())
    return limit_depth(written(rows.withColumns({"track_rows": F.count("*").over(WT()), "track_cuts": cuts})), s)


def _long_enough(rows: str, s: Settings) -> Column:
    """Parts of a cut track need three rows at least, an uncut one two."""
    return F.col(rows) >= F.greatest(min_rows(s), F.when(F.col("track_cuts") > 0, 3).otherwise(2))


def track_reasons(cut: DataFrame, s: Settings) -> DataFrame:
    """The reason of each track: the least of 8, 7, 6 and its fragments' reasons, as far as each is reached."""
    frags = fragment_profile(cut, s).where(_long_enough("n_rows", s)).groupBy(*KEY).agg(F.min("reason").alias("best"))
    runs = cut.where("hole_id is not null").groupBy(*KEY, "hole_id").agg(F.count("*").alias("n"), F.first("fps").alias("fps"), F.first("track_cuts").alias("track_cuts"))
    runs = runs.groupBy(*KEY).agg(F.max(_long_enough("n", s).cast("int")).alias("run"))
    tracks = cut.groupBy(*KEY).agg(F.count("*").alias("n"), F.first("fps").alias("fps"))
    joined = tracks.join(runs, KEY, "left").join(frags, KEY, "left")
    reason = F.least(F.lit(8), F.when(F.col("n") >= min_rows(s), 7), F.when(F.col("run") == 1, 6), F.col("best"))
    return joined.select(*KEY, reason.alias("reason"))


def longest_fragment(profile: DataFrame, s: Settings) -> DataFrame:
    """The longest accepted fragment of each track by rows, the earliest on ties, cut to the length limit."""
    best = Window.partitionBy(*KEY).orderBy(F.desc("n_rows"), "start_t")
    ok = profile.where((F.col("reason") == 0) & _long_enough("n_rows", s))
    first = ok.withColumn("r", F.row_number().over(best)).where("r = 1")
    limit = F.floor(F.lit(s.limit_length_s) * F.bround("fps"))
    stop = F.least(F.col("stop_t"), F.col("start_t") + limit - 1) if s.limit_length_s else F.col("stop_t")
    return first.select(*KEY, "fragment_id", "n_rows", "start_t", stop.cast("long").alias("stop_t"), (F.col("start_t") + limit - 1).cast("long").alias("limit_t"))


def keep_fragments(rows: DataFrame, chosen: DataFrame, s: Settings) -> DataFrame:
    """Rows inside the chosen span of their track; in exact mode only of tracks with a row at the limit."""
    c = chosen.select(*KEY, "start_t", "stop_t", "limit_t")
    out = rows.where(~F.col("outlier")).join(c, KEY).where("position_t between start_t and stop_t")
    if s.limit_exactly and s.limit_length_s:
        out = out.withColumn("hit", F.max((F.col("position_t") == F.col("limit_t")).cast("int")).over(WT())).where("hit = 1")
    return out


def select_tracks(df: DataFrame, s: Settings, accuracy: int | None = None) -> DataFrame:
    """The selected rows, in the columns of ``tracks``. ``df`` has fps and frame size."""
    cut = cut_tracks(df, s, accuracy)
    return keep_fragments(cut, longest_fragment(fragment_profile(cut, s), s), s).select(*TRACK_COLUMNS)


def selection_report(df: DataFrame, cut: DataFrame, s: Settings) -> DataFrame:
    """Per recording: rows before and after cleaning, share lost, tracks by reason, and whether few were accepted."""
    before = df.groupBy("recording_id").agg(F.count("*").alias("rows_before"))
    after = cut.groupBy("recording_id").agg(F.count("*").alias("rows_after"))
    reasons = track_reasons(cut, s).groupBy("recording_id").pivot("reason", list(range(9))).count()
    reasons = reasons.select("recording_id", *[F.coalesce(F.col(f"`{i}`"), F.lit(0)).alias(f"reason_{i}") for i in range(9)])
    total = sum((F.col(f"reason_{i}") for i in range(1, 9)), F.col("reason_0"))
    out = before.join(after, "recording_id", "left").join(reasons, "recording_id", "left").fillna(0)
    return out.withColumns(
        {
            "lost_share": 1 - F.col("rows_after") / F.col("rows_before"),
            "few_accepted": (F.col("reason_0") < 1000) & (F.coalesce(F.try_divide(F.col("reason_0"), total), F.lit(0.0)) < 0.3),
        }
    )
