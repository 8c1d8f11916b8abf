"""Registered queries over the fixtures, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import evaluate, linking, select, slices, summary, tracking
from ..schemas import KEY, TRACK_COLUMNS
from ..sources import files
from ..sources.tables import scratch, written
from ..streaming import jobs
from . import fixtures, pipeline

S = fixtures.SETTINGS
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = _full(sql)
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Computed doubles rounded, as in the SQL."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.with_recording(fixtures.tracks(spark, sf_dir), fixtures.recordings(spark, sf_dir), S)


def cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.cut_tracks(prepared(spark, sf_dir), S)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all tracks' rows that are not lost (every phenotype occurs among them)."""
    return evaluate.features(prepared(spark, sf_dir).where("width > 0"), S)


# The SQL of the steps, each reading the ones before it.
_PX = "1.41888781"
_STEPS: dict[str, str] = {
    "tracks": fixtures.TRACKS,
    "recordings": fixtures.RECORDINGS,
    "frame_stats": fixtures.FRAME_STATS,
    "prepared": """SELECT t.*, CASE WHEN r.fps > 0 THEN r.fps ELSE 30.0 END AS fps,
        CASE WHEN r.frame_width IS NULL THEN 922 ELSE r.frame_height END AS frame_height, coalesce(r.frame_width, 1228) AS frame_width
        FROM tracks t LEFT JOIN recordings r USING (recording_id)""",
    "areas": """SELECT *, width * height AS area, median(width * height) OVER k AS median_area,
        max(position_t) OVER k - min(position_t) OVER k + 1 AS length FROM prepared WINDOW k AS (PARTITION BY recording_id, track_id)""",
    "clean": """SELECT * FROM areas WHERE median_area BETWEEN 2 AND 50 AND area <> 0 AND area <= 1.5 * median_area
        AND length >= 5 * round_even(fps, 0)""",
    "speeds": """SELECT *, position_t - lag(position_t) OVER k AS gap,
        coalesce(sqrt(pow(position_x - lag(position_x) OVER k, 2) + pow(position_y - lag(position_y) OVER k, 2)) / (position_t - lag(position_t) OVER k), 0) AS speed
        FROM clean WINDOW k AS (PARTITION BY recording_id, track_id ORDER BY position_t)""",
    "bounds": """SELECT recording_id, quantile_cont(area, 0.1) AS q_lo, quantile_cont(area, 0.9) AS q_hi,
        quantile_cont(speed, 0.75) + 3 * (quantile_cont(speed, 0.75) - quantile_cont(speed, 0.25)) AS fence FROM speeds GROUP BY 1""",
    "switches": """SELECT recording_id, any_value(fence) AS fence, avg(CASE WHEN speed > fence THEN 1.0 ELSE 0.0 END) AS share,
        avg(CASE WHEN speed > fence THEN 1.0 ELSE 0.0 END) <= 0.05 AS use FROM speeds JOIN bounds USING (recording_id) GROUP BY 1""",
    "flagged": """SELECT s.*, b.q_lo, b.q_hi, w.use AND s.speed > b.fence AS outlier
        FROM speeds s JOIN bounds b USING (recording_id) JOIN switches w USING (recording_id)""",
    "cut": """SELECT *, sum(CASE WHEN gap > 5 THEN 1 ELSE 0 END) OVER k AS hole_id,
        sum(CASE WHEN gap > 5 THEN 1 ELSE 0 END + CASE WHEN outlier THEN 1 ELSE 0 END) OVER k AS fragment_id
        FROM flagged WINDOW k AS (PARTITION BY recording_id, track_id ORDER BY position_t)""",
    "profile0": """SELECT recording_id, track_id, fragment_id, count(*) AS n_rows, min(position_t) AS start_t, max(position_t) AS stop_t,
        avg(area) AS avg_area, avg(least(width, height) / greatest(width, height)) AS avg_ratio,
        avg(position_x) AS avg_x, min(position_x) AS min_x, max(position_x) AS max_x,
        avg(position_y) AS avg_y, min(position_y) AS min_y, max(position_y) AS max_y,
        any_value(fps) AS fps, any_value(frame_height) AS fh, any_value(frame_width) AS fw, any_value(q_lo) AS q_lo, any_value(q_hi) AS q_hi
        FROM cut WHERE NOT outlier GROUP BY 1, 2, 3""",
    "profile": """SELECT *, CASE WHEN NOT ((stop_t - start_t + 1) / n_rows < 1.09) THEN 5 WHEN NOT (avg_area BETWEEN q_lo AND q_hi) THEN 4
        WHEN NOT (avg_ratio > 0.30 AND avg_ratio < 0.67) THEN 3
        WHEN NOT (avg_x > fw * 0.05 AND avg_x < fw * 0.95 AND avg_y > fh * 0.05 AND avg_y < fh * 0.95) THEN 2
        WHEN NOT (min_x >= 0 AND max_x <= fw AND min_y >= 0 AND max_y <= fh) THEN 1 ELSE 0 END AS reason FROM profile0""",
    "reasons": """SELECT t.recording_id, t.track_id, least(8, CASE WHEN t.n >= 5 * round_even(t.fps, 0) THEN 7 ELSE 8 END, coalesce(h.r, 8), coalesce(f.r, 8)) AS reason
        FROM (SELECT recording_id, track_id, count(*) AS n, any_value(fps) AS fps FROM cut GROUP BY 1, 2) t
        LEFT JOIN (SELECT recording_id, track_id, 6 AS r FROM (SELECT recording_id, track_id, hole_id, count(*) AS n, any_value(fps) AS fps FROM cut GROUP BY 1, 2, 3)
                   WHERE n >= 5 * round_even(fps, 0) GROUP BY 1, 2) h USING (recording_id, track_id)
        LEFT JOIN (SELECT recording_id, track_id, min(reason) AS r FROM profile WHERE n_rows >= 5 * round_even(fps, 0) GROUP BY 1, 2) f USING (recording_id, track_id)""",
    "chosen": """SELECT recording_id, track_id, fragment_id, n_rows, start_t, least(stop_t, CAST(start_t + 5 * round_even(fps, 0) - 1 AS BIGINT)) AS stop_t,
        CAST(start_t + 5 * round_even(fps, 0) - 1 AS BIGINT) AS limit_t
        FROM profile WHERE reason = 0 AND n_rows >= 5 * round_even(fps, 0)
        QUALIFY row_number() OVER (PARTITION BY recording_id, track_id ORDER BY n_rows DESC, start_t) = 1""",
    "selected": """SELECT c.recording_id, c.track_id, c.position_t, c.position_x, c.position_y, c.width, c.height, c.degrees_angle
        FROM cut c JOIN chosen f USING (recording_id, track_id) WHERE NOT c.outlier AND c.position_t BETWEEN f.start_t AND f.stop_t""",
    "steps": f"""SELECT *, sqrt(dx * dx + dy * dy) / {_PX} AS travelled_dist, greatest(width, height) AS bac_length,
        CASE WHEN sqrt(dx * dx + dy * dy) / {_PX} / dt > 1e-3 THEN 1 ELSE 0 END AS moving_raw
        FROM (SELECT recording_id, track_id, position_t, position_x, position_y, width / {_PX} AS width, height / {_PX} AS height, degrees_angle, fps,
          coalesce(position_x - lag(position_x) OVER k, 0) AS dx, coalesce(position_y - lag(position_y) OVER k, 0) AS dy,
          coalesce(position_t - lag(position_t) OVER k, 1) AS dt, position_t - first(position_t) OVER k AS t_norm,
          (position_x - first(position_x) OVER k) / {_PX} AS x_norm, (position_y - first(position_y) OVER k) / {_PX} AS y_norm
          FROM prepared WHERE width > 0 WINDOW k AS (PARTITION BY recording_id, track_id ORDER BY position_t))""",
    "moved0": """SELECT *, CASE WHEN sum(moving_raw) OVER (PARTITION BY recording_id, track_id ORDER BY position_t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) > 1 THEN 1 ELSE 0 END AS m1 FROM steps""",
    "moved": """SELECT * EXCLUDE (m1), CASE WHEN fps = 25 THEN
          CASE WHEN sum(m1) OVER (PARTITION BY recording_id, track_id ORDER BY position_t ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) > 12 THEN 1 ELSE 0 END
        ELSE CASE WHEN sum(m1) OVER (PARTITION BY recording_id, track_id ORDER BY position_t ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) > 15 THEN 1 ELSE 0 END END AS moving FROM moved0""",
    "headed0": """SELECT *, atan2(position_x - lag(position_x, 10) OVER k, position_y - lag(position_y, 10) OVER k) AS heading
        FROM moved WINDOW k AS (PARTITION BY recording_id, track_id ORDER BY position_t)""",
    "headed": """SELECT * EXCLUDE (a), CAST(trunc(round(least(a, 360 - a), 9)) AS INT) AS angle_diff FROM (SELECT *, degrees(heading) AS heading_deg,
          coalesce(abs(degrees(heading) - lag(degrees(heading)) OVER (PARTITION BY recording_id, track_id ORDER BY position_t)), 0) AS a FROM headed0)""",
    "turned0": "SELECT *, CASE WHEN angle_diff > 30 AND moving = 1 THEN angle_diff ELSE 0 END AS turn_candidate FROM headed",
    "turned": """SELECT *, CASE WHEN row_number() OVER (PARTITION BY recording_id, track_id ORDER BY position_t) = 1 THEN 1
        WHEN turn_candidate <> 0 AND turn_candidate = max(turn_candidate) OVER (PARTITION BY recording_id, track_id ORDER BY position_t ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) THEN 1 ELSE 0 END AS turn_points FROM turned0""",
    "ran0": """SELECT * EXCLUDE (b), CASE WHEN moving = 1 THEN CAST(sum(b) OVER (PARTITION BY recording_id, track_id ORDER BY position_t) AS BIGINT) END AS tp_of_tracks
        FROM (SELECT *, CASE WHEN turn_points = 1 AND coalesce(lag(turn_points) OVER (PARTITION BY recording_id, track_id ORDER BY position_t), 0) = 0 THEN 1 ELSE 0 END AS b FROM turned)""",
    "ran": "SELECT *, CASE WHEN tp_of_tracks IS NOT NULL THEN sum(travelled_dist) OVER (PARTITION BY recording_id, track_id, tp_of_tracks) END AS run_distance FROM ran0",
    "far": f"""SELECT *, CASE WHEN fps = 25 THEN sqrt(pow(position_x - lag(position_x, 62) OVER k, 2) + pow(position_y - lag(position_y, 62) OVER k, 2))
          ELSE sqrt(pow(position_x - lag(position_x, 75) OVER k, 2) + pow(position_y - lag(position_y, 75) OVER k, 2)) END / {_PX} AS lag_displacement
        FROM ran WINDOW k AS (PARTITION BY recording_id, track_id ORDER BY position_t)""",
    "kinds": """SELECT *, CASE WHEN displacement_ratio > 1.5 AND run_ratio > 5 THEN 2 WHEN displacement_ratio > 1.5 AND run_ratio <= 5 THEN 1 ELSE 0 END AS motility_phenotype
        FROM (SELECT *, max(lag_displacement) OVER k / avg(bac_length) OVER k AS displacement_ratio, max(run_distance) OVER k / avg(bac_length) OVER k AS run_ratio
          FROM far WINDOW k AS (PARTITION BY recording_id, track_id))""",
    "found": """SELECT * REPLACE (CASE WHEN row_number() OVER (PARTITION BY recording_id, track_id ORDER BY position_t) = 1 THEN 1
        WHEN motility_phenotype = 0 THEN 0 ELSE turn_points END AS turn_points) FROM kinds""",
    "indexed": """SELECT f.*, b.before + row_number() OVER (PARTITION BY recording_id, track_id ORDER BY position_t) - 1 AS row_index
        FROM found f JOIN (SELECT recording_id, track_id, coalesce(sum(n) OVER (PARTITION BY recording_id ORDER BY track_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM (SELECT recording_id, track_id, count(*) AS n FROM found GROUP BY 1, 2)) b USING (recording_id, track_id)""",
    "medians": """SELECT recording_id, track_id, median(path) AS median_speed FROM
        (SELECT recording_id, track_id, floor(row_index / fps) AS bin, sum(travelled_dist) AS path FROM indexed GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "farthest": """SELECT a.recording_id, a.track_id, max(sqrt(pow(a.x_norm - b.x_norm, 2) + pow(a.y_norm - b.y_norm, 2))) AS displacement_um
        FROM found a JOIN found b USING (recording_id, track_id) GROUP BY 1, 2""",
    "stats": """SELECT recording_id, track_id, CASE WHEN m = 0 THEN 0 ELSE (tp - 1) * fps / m END AS turn_points_per_s, d AS distance_um,
        CASE WHEN m = 0 THEN 0 ELSE d / ((t + 1) / fps) END AS speed_um_s, (t + 1) / fps AS time_s, displacement_um, m / (t + 1) * 100 AS perc_motile,
        CASE WHEN d <> 0 THEN sqrt(ex * ex + ey * ey) / d ELSE 0 END AS arc_chord_ratio, l AS bac_length_um,
        CASE WHEN l <> 0 THEN displacement_um / l ELSE 0 END AS displacement_by_length, motility_phenotype, median_speed
        FROM (SELECT recording_id, track_id, max(t_norm) AS t, sum(moving) AS m, sum(travelled_dist) AS d, avg(bac_length) AS l, sum(turn_points) AS tp,
          arg_max(x_norm, position_t) AS ex, arg_max(y_norm, position_t) AS ey, arg_max(motility_phenotype, position_t) AS motility_phenotype, max(fps) AS fps
          FROM found GROUP BY 1, 2) JOIN farthest USING (recording_id, track_id) JOIN medians USING (recording_id, track_id)""",
    "labelled": """SELECT *, CASE WHEN perc_motile >= 80 AND perc_motile < 100.01 THEN 5 WHEN perc_motile >= 60 AND perc_motile < 80 THEN 4 WHEN perc_motile >= 40 AND perc_motile < 60 THEN 3
        WHEN perc_motile >= 20 AND perc_motile < 40 THEN 2 WHEN perc_motile >= 0 AND perc_motile < 20 THEN 1 END AS category_order FROM stats""",
    "categorised": """SELECT * EXCLUDE (category_order), 'All' AS category, 0 AS category_order FROM labelled UNION ALL
        SELECT * EXCLUDE (category_order), format('{:.1f}% - {:.1f}%', (category_order - 1) * 20.0, category_order * 20.0), category_order FROM labelled WHERE category_order IS NOT NULL""",
    "long": """SELECT * FROM (UNPIVOT categorised ON turn_points_per_s, distance_um, speed_um_s, time_s, displacement_um, perc_motile, arc_chord_ratio, bac_length_um INTO NAME metric VALUE value)""",
    "paths": """SELECT recording_id, track_id, path, (path - min(path) OVER r) / nullif(max(path) OVER r - min(path) OVER r, 0) AS colour
        FROM (SELECT recording_id, track_id, sum(travelled_dist) AS path FROM found GROUP BY 1, 2) WINDOW r AS (PARTITION BY recording_id)""",
    "detections": """SELECT recording_id, position_t AS frame, row_number() OVER (PARTITION BY recording_id, position_t ORDER BY track_id) AS det_id,
        position_x AS x, position_y AS y, width, height, degrees_angle FROM tracks WHERE width > 0""",
}


def _full(sql: str) -> str:
    """``sql`` with the steps that it needs as common tables."""
    import re

    needed, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name in _STEPS:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|UNPIVOT {name}\b", text):
                needed.add(name)
                todo.append(_STEPS[name])
    parts = [f"{name} AS MATERIALIZED ({body})" for name, body in _STEPS.items() if name in needed]
    return "WITH RECURSIVE " + ", ".join(parts) + sql if parts else sql


_T = ", ".join(TRACK_COLUMNS)


@query(f" SELECT {_T} FROM tracks")
def o1_fixture_tracks(spark, sf_dir):
    return fixtures.tracks(spark, sf_dir).repartition(*KEY).sortWithinPartitions(*KEY, "position_t")


@query(" SELECT recording_id, track_id, position_t, fps, CAST(frame_height AS INT) AS frame_height, CAST(frame_width AS INT) AS frame_width FROM prepared")
def j1_with_recording(spark, sf_dir):
    return prepared(spark, sf_dir).select(*KEY, "position_t", "fps", "frame_height", "frame_width")


@query(" SELECT recording_id, track_id, position_t, area, median_area, length FROM areas")
def a1_track_median_area(spark, sf_dir):
    return select.with_track_area(prepared(spark, sf_dir)).select(*KEY, "position_t", "area", "median_area", "length")


@query(f" SELECT {_T} FROM clean")
def p7_clean_rows(spark, sf_dir):
    return select.guard_recordings(written(select.clean_rows(prepared(spark, sf_dir), S).select(*TRACK_COLUMNS, "fps")), S).select(*TRACK_COLUMNS)


@query(" SELECT recording_id, name, frame_count FROM recordings WHERE frame_count >= 600 AND recording_id IN (SELECT recording_id FROM tracks)")
def p9_guard_frame_count(spark, sf_dir):
    kept = select.guard_frame_count(fixtures.recordings(spark, sf_dir), S)
    return kept.join(fixtures.tracks(spark, sf_dir), "recording_id", "left_semi").select("recording_id", "name", "frame_count")


@query(" SELECT recording_id, round(q_lo, 6) AS q_lo, round(q_hi, 6) AS q_hi FROM bounds")
def a2_area_bounds(spark, sf_dir):
    return rounded(select.area_bounds(select.clean_rows(prepared(spark, sf_dir), S), S))


@query(" SELECT recording_id, track_id, position_t, gap, round(speed, 6) AS speed FROM speeds")
def w3_raw_speed(spark, sf_dir):
    return rounded(select.with_speed(select.clean_rows(prepared(spark, sf_dir), S)).select(*KEY, "position_t", "gap", "speed"))


@query(" SELECT recording_id, round(fence, 6) AS fence, round(share, 6) AS share, use FROM switches")
def a4_outlier_switch(spark, sf_dir):
    rows = select.with_speed(select.clean_rows(prepared(spark, sf_dir), S))
    return rounded(select.outlier_switch(rows, select.speed_fence(rows), S).select("recording_id", "fence", "share", "use"))


@query(" SELECT recording_id, track_id, position_t, outlier, CAST(hole_id AS BIGINT) AS hole_id, CAST(fragment_id AS BIGINT) AS fragment_id FROM cut")
def w5_fragments(spark, sf_dir):
    return cut(spark, sf_dir).select(*KEY, "position_t", "outlier", "hole_id", "fragment_id")


@query(" SELECT recording_id, track_id, CAST(fragment_id AS BIGINT) AS fragment_id, n_rows, start_t, stop_t, round(avg_area, 6) AS avg_area, round(avg_ratio, 6) AS avg_ratio, round(avg_x, 6) AS avg_x, min_x, max_x, round(avg_y, 6) AS avg_y, min_y, max_y, reason FROM profile")
def a5_fragment_profile(spark, sf_dir):
    cols = ["fragment_id", "n_rows", "start_t", "stop_t", "avg_area", "avg_ratio", "avg_x", "min_x", "max_x", "avg_y", "min_y", "max_y", "reason"]
    return rounded(select.fragment_profile(cut(spark, sf_dir), S).select(*KEY, *cols))


@query(" SELECT recording_id, track_id, reason FROM reasons")
def p16_track_reasons(spark, sf_dir):
    return select.track_reasons(cut(spark, sf_dir), S)


@query(" SELECT recording_id, track_id, CAST(fragment_id AS BIGINT) AS fragment_id, n_rows, start_t, stop_t, limit_t FROM chosen")
def w6_longest_fragment(spark, sf_dir):
    return select.longest_fragment(select.fragment_profile(cut(spark, sf_dir), S), S)


@query(f" SELECT {_T} FROM selected")
def j3_select_tracks(spark, sf_dir):
    return select.select_tracks(prepared(spark, sf_dir), S)


@query(f" SELECT {_T} FROM selected s JOIN (SELECT recording_id, track_id FROM selected JOIN chosen USING (recording_id, track_id) WHERE position_t = limit_t) e USING (recording_id, track_id)")
def w7_limit_exactly(spark, sf_dir):
    from dataclasses import replace

    return select.select_tracks(prepared(spark, sf_dir), replace(S, limit_exactly=True))


@query(
    """ SELECT b.recording_id, rows_before, rows_after, reason_0, reason_1, reason_2, reason_3, reason_4, reason_5, reason_6, reason_7, reason_8,
    round(1 - rows_after / rows_before, 6) AS lost_share, reason_0 < 1000 AND reason_0 / n < 0.3 AS few_accepted
    FROM (SELECT recording_id, count(*) AS rows_before FROM prepared GROUP BY 1) b JOIN (SELECT recording_id, count(*) AS rows_after FROM cut GROUP BY 1) a USING (recording_id)
    JOIN (SELECT recording_id, count(*) AS n, """
    + ", ".join(f"count(*) FILTER (reason = {i}) AS reason_{i}" for i in range(9))
    + " FROM reasons GROUP BY 1) r USING (recording_id)"
)
def a6_selection_report(spark, sf_dir):
    return rounded(select.selection_report(prepared(spark, sf_dir), cut(spark, sf_dir), S))


@query(" SELECT recording_id, track_id, position_t, round(width, 6) AS width, round(height, 6) AS height, dx, dy, dt, t_norm, round(travelled_dist, 6) AS travelled_dist, round(bac_length, 6) AS bac_length, round(x_norm, 6) AS x_norm, round(y_norm, 6) AS y_norm, moving_raw FROM (SELECT * REPLACE (round(dx, 6) AS dx, round(dy, 6) AS dy) FROM steps)")
def w2_steps(spark, sf_dir):
    out = evaluate.steps(prepared(spark, sf_dir).where("width > 0"), S)
    return rounded(out.select(*KEY, "position_t", "width", "height", "dx", "dy", "dt", "t_norm", "travelled_dist", "bac_length", "x_norm", "y_norm", "moving_raw"))


@query(" SELECT recording_id, track_id, position_t, moving_raw, moving FROM moved")
def w8_binary_median(spark, sf_dir):
    rows = prepared(spark, sf_dir).where("width > 0")
    return evaluate.moving(evaluate.steps(rows, S)).select(*KEY, "position_t", "moving_raw", "moving")


@query(" SELECT recording_id, track_id, position_t, round(heading, 6) AS heading, round(heading_deg, 6) AS heading_deg, angle_diff FROM headed")
def w11_turn_angle(spark, sf_dir):
    return rounded(found(spark, sf_dir).select(*KEY, "position_t", "heading", "heading_deg", "angle_diff"))


@query(" SELECT recording_id, track_id, position_t, turn_candidate, turn_points, tp_of_tracks, round(run_distance, 6) AS run_distance FROM ran")
def w13_turns_and_runs(spark, sf_dir):
    rows = evaluate.steps(prepared(spark, sf_dir).where("width > 0"), S)
    return rounded(evaluate.runs(evaluate.turns(evaluate.headings(evaluate.moving(rows), S), S)).select(*KEY, "position_t", "turn_candidate", "turn_points", "tp_of_tracks", "run_distance"))


@query(" SELECT DISTINCT recording_id, track_id, round(displacement_ratio, 6) AS displacement_ratio, round(run_ratio, 6) AS run_ratio, motility_phenotype FROM found")
def a16_motility_ratios(spark, sf_dir):
    return rounded(found(spark, sf_dir).groupBy(*KEY).agg(*[F.first(c).alias(c) for c in ("displacement_ratio", "run_ratio", "motility_phenotype")]))


@query(" SELECT recording_id, track_id, position_t, position_x, position_y, round(width, 6) AS width, round(height, 6) AS height, degrees_angle, angle_diff, moving, turn_points, tp_of_tracks, round(travelled_dist, 6) AS travelled_dist, motility_phenotype FROM found")
def p17_analysed(spark, sf_dir):
    return rounded(evaluate.analysed(found(spark, sf_dir)))


@query(" SELECT recording_id, track_id, position_t, CAST(row_index AS BIGINT) AS row_index FROM indexed")
def w12_recording_row_index(spark, sf_dir):
    return evaluate.recording_row_index(found(spark, sf_dir)).select(*KEY, "position_t", "row_index")


@query(" SELECT recording_id, track_id, round(median_speed, 6) AS median_speed FROM medians")
def a9_median_speed(spark, sf_dir):
    return rounded(evaluate.median_speed(found(spark, sf_dir)))


@query(" SELECT recording_id, track_id, round(displacement_um, 6) AS displacement_um FROM farthest")
def a8_max_displacement(spark, sf_dir):
    return rounded(evaluate.max_displacement(found(spark, sf_dir)))


_STATS = "round(turn_points_per_s, 6) AS turn_points_per_s, round(distance_um, 6) AS distance_um, round(speed_um_s, 6) AS speed_um_s, round(time_s, 6) AS time_s, round(displacement_um, 6) AS displacement_um, round(perc_motile, 6) AS perc_motile, round(arc_chord_ratio, 6) AS arc_chord_ratio, round(bac_length_um, 6) AS bac_length_um, round(displacement_by_length, 6) AS displacement_by_length, motility_phenotype, round(median_speed, 6) AS median_speed"


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.track_stats(found(spark, sf_dir))


@query(f" SELECT recording_id, track_id, {_STATS} FROM stats")
def a7_track_stats(spark, sf_dir):
    return rounded(stats(spark, sf_dir))


@query(
    """ SELECT recording_id, count(*) AS tracks, round(avg(CASE WHEN motility_phenotype = 0 THEN 1.0 ELSE 0 END), 6) AS immotile_share, round(avg(CASE WHEN motility_phenotype = 1 THEN 1.0 ELSE 0 END), 6) AS twitching_share,
    round(avg(CASE WHEN motility_phenotype = 2 THEN 1.0 ELSE 0 END), 6) AS motile_share, round(min(time_s), 6) AS time_min, round(max(time_s), 6) AS time_max,
    round(quantile_cont(time_s, 0.25), 6) AS time_q25, round(quantile_cont(time_s, 0.5), 6) AS time_q50, round(quantile_cont(time_s, 0.75), 6) AS time_q75 FROM stats GROUP BY 1"""
)
def a10_recording_summary(spark, sf_dir):
    return rounded(summary.recording_summary(stats(spark, sf_dir)))


@query(" SELECT recording_id, track_id, category, category_order, round(perc_motile, 6) AS perc_motile FROM categorised")
def u1_categorise(spark, sf_dir):
    out = summary.order_categories(summary.categorise(written(stats(spark, sf_dir)), S.split_by, S.split_on))
    return rounded(out.select(*KEY, "category", "category_order", "perc_motile"))


@query(
    """ SELECT recording_id, metric, category, category_order, n, round(median, 6) AS median, round(mean, 6) AS mean,
    round(n / max(CASE WHEN category_order = 0 THEN n END) OVER (PARTITION BY recording_id, metric) * 100, 6) AS percent FROM
    (SELECT recording_id, metric, category, category_order, count(*) AS n, median(value) AS median, avg(value) AS mean FROM long GROUP BY ALL)"""
)
def a13_category_summary(spark, sf_dir):
    return rounded(summary.category_summary(summary.categorise(written(stats(spark, sf_dir)), S.split_by, S.split_on)))


@query(" SELECT recording_id, metric, category, count(*) AS n, round(median(value), 6) AS median, round(avg(value), 6) AS mean FROM long GROUP BY ALL")
def a14_category_summary_sets(spark, sf_dir):
    return rounded(summary.category_summary_sets(stats(spark, sf_dir), S.split_by, S.split_on))


@query(" SELECT recording_id, track_id, round(path, 6) AS path, round(colour, 6) AS colour FROM paths")
def a11_distance_colour(spark, sf_dir):
    return rounded(summary.distance_colour(found(spark, sf_dir)))


@query(
    """ , chosen_rows AS (SELECT * FROM (SELECT *, avg(moving) OVER (PARTITION BY recording_id, track_id) AS share FROM found) WHERE share > 0.7 AND moving = 1)
    SELECT r.recording_id, CAST(b.bin AS INT) AS bin, coalesce(c.n, 0) AS n, r.rows_selected FROM (SELECT recording_id, count(*) AS rows_selected FROM chosen_rows GROUP BY 1) r
    CROSS JOIN range(36) b(bin) LEFT JOIN (SELECT recording_id, least(floor((heading + pi()) / (2 * pi() / 36)), 35) AS bin, count(*) AS n FROM chosen_rows WHERE heading IS NOT NULL GROUP BY 1, 2) c
    ON c.recording_id = r.recording_id AND c.bin = b.bin"""
)
def a12_angle_histogram(spark, sf_dir):
    return evaluate.angle_histogram(found(spark, sf_dir))


@query(
    f""" SELECT recording_id, track_id, position_t, round(position_x / {_PX}, 6) AS x_um, round(position_y / {_PX}, 6) AS y_um, round(first(position_x) OVER k / {_PX}, 6) AS start_x_um,
    round(first(position_y) OVER k / {_PX}, 6) AS start_y_um, round(colour, 6) AS colour FROM found JOIN paths USING (recording_id, track_id) WINDOW k AS (PARTITION BY recording_id, track_id ORDER BY position_t)"""
)
def s8_overview_points(spark, sf_dir):
    return rounded(summary.overview_points(found(spark, sf_dir), S))


@query(" SELECT recording_id, track_id, position_t, round(x_norm, 6) AS x_rel, round(y_norm, 6) AS y_rel, round(colour, 6) AS colour FROM found JOIN paths USING (recording_id, track_id)")
def s8_rose_points(spark, sf_dir):
    return rounded(summary.rose_points(found(spark, sf_dir), S))


@query(f" SELECT recording_id, track_id, {_STATS} FROM stats ORDER BY stats.distance_um DESC, recording_id, track_id LIMIT 10")
def o3_longest_tracks(spark, sf_dir):
    return rounded(summary.longest_tracks(stats(spark, sf_dir), 10))


_COLOUR = "CASE WHEN moving = 0 THEN 'orange' WHEN turn_points = 1 THEN 'white' ELSE 'green' END"


@query(f" SELECT recording_id, position_t, track_id, CAST(trunc(position_x) AS INT) AS x, CAST(trunc(position_y) AS INT) AS y, {_COLOUR} AS colour FROM found WHERE motility_phenotype = 2")
def s9_overlay(spark, sf_dir):
    return summary.overlay(found(spark, sf_dir), "motile").select("recording_id", "position_t", F.inline("marks"))


@query(" SELECT recording_id, position_t, count(track_id) AS n FROM (SELECT DISTINCT recording_id, position_t FROM tracks) LEFT JOIN (SELECT recording_id, position_t, track_id FROM found WHERE motility_phenotype = 1) USING (recording_id, position_t) GROUP BY 1, 2")
def j7_overlay_for_frames(spark, sf_dir):
    frames = fixtures.tracks(spark, sf_dir).select("recording_id", "position_t").distinct()
    out = summary.overlay_for_frames(frames, summary.overlay(found(spark, sf_dir), "twitching"))
    return out.select("recording_id", "position_t", F.coalesce(F.size("marks"), F.lit(0)).cast("long").alias("n"))


@query(
    """ , pairs AS (SELECT a.recording_id, a.frame, a.det_id, b.det_id AS next_id, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS distance FROM detections a JOIN detections b ON a.recording_id = b.recording_id AND b.frame = a.frame + 1),
    want AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY recording_id, frame, det_id ORDER BY distance, next_id) = 1)
    SELECT recording_id, frame, det_id, round(distance, 6) AS distance, next_id FROM want QUALIFY row_number() OVER (PARTITION BY recording_id, frame, next_id ORDER BY distance, det_id) = 1"""
)
def j5_link_consecutive(spark, sf_dir):
    return rounded(linking.link_consecutive(fixtures.detections(fixtures.tracks(spark, sf_dir))))


@query(
    """ SELECT recording_id, frame, det_id FROM detections c WHERE EXISTS (SELECT 1 FROM (SELECT recording_id, frame, x + 1.0 AS x, y - 0.5 AS y FROM detections WHERE det_id % 3 <> 0) m
    WHERE m.recording_id = c.recording_id AND m.frame = c.frame
    AND abs((m.x - c.x) * cos(radians(c.degrees_angle)) + (m.y - c.y) * sin(radians(c.degrees_angle))) <= c.width / 2
    AND abs((m.y - c.y) * cos(radians(c.degrees_angle)) - (m.x - c.x) * sin(radians(c.degrees_angle))) <= c.height / 2)"""
)
def j6_keep_marked(spark, sf_dir):
    d = fixtures.detections(fixtures.tracks(spark, sf_dir))
    markers = d.where("det_id % 3 <> 0").withColumns({"x": F.col("x") + 1.0, "y": F.col("y") - 0.5})
    return linking.keep_marked(d, markers).select("recording_id", "frame", "det_id")


@query(
    """ SELECT recording_id, track_id, position_t, round(avg(position_x) OVER (k ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 6) AS mean_x, lag(position_t, 2, -1) OVER k AS before, lead(position_t, 2, -1) OVER k AS after,
    row_number() OVER k = 1 AS start, lead(1) OVER k IS NULL AS stop FROM tracks WINDOW k AS (PARTITION BY recording_id, track_id ORDER BY position_t)"""
)
def w16_rolling_and_shift(spark, sf_dir):
    return rounded(
        fixtures.tracks(spark, sf_dir).select(
            *KEY, "position_t", C.rolling_mean_centered("position_x", 6).alias("mean_x"), C.shift("position_t", 2, -1).alias("before"),
            C.shift("position_t", -2, -1).alias("after"), C.is_start().alias("start"), C.is_stop().alias("stop"),
        )
    )


@query(" SELECT recording_id, frame, CAST(trunc(avg(grey_mean + grey_std + 5) OVER (PARTITION BY recording_id ORDER BY frame ROWS BETWEEN 150 PRECEDING AND CURRENT ROW)) AS INT) AS threshold FROM frame_stats")
def w18_moving_threshold(spark, sf_dir):
    return fixtures.frame_stats(spark, sf_dir).select("recording_id", "frame", C.moving_threshold(30.0, 5).alias("threshold"))


@query(
    """ SELECT recording_id, track_id, position_t, CASE WHEN count(*) OVER w = 10 THEN round(regr_slope(position_x, rn) OVER w * rn + regr_intercept(position_x, rn) OVER w, 5) END AS next_x
    FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, track_id ORDER BY position_t) AS rn FROM tracks) WINDOW w AS (PARTITION BY recording_id, track_id ORDER BY position_t ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"""
)
def w19_lsf_predict(spark, sf_dir):
    return rounded(fixtures.tracks(spark, sf_dir).select(*KEY, "position_t", C.lsf_predict("position_x", 10).alias("next_x")), 5)


@query(
    """ SELECT recording_id, strftime(CASE WHEN regexp_matches(name, '^[0-9]{12}') THEN strptime(left(name, 12), '%y%m%d%H%M%S') END, '%Y-%m-%d %H:%M:%S') AS at,
    CASE WHEN regexp_matches(name, '^[0-9]{12}') THEN strftime(strptime(left(name, 12), '%y%m%d%H%M%S'), '%Y-%m-%d %H:%M:%S') || ' ' || trim(substr(plain, 13)) ELSE plain END AS display, n
    FROM (SELECT *, regexp_replace(replace(name, '_', ' '), ' selected data$', '') AS plain FROM recordings) JOIN (SELECT recording_id, count(*) AS n FROM tracks GROUP BY 1) USING (recording_id)"""
)
def f5_names(spark, sf_dir):
    rows = fixtures.tracks(spark, sf_dir).groupBy("recording_id").agg(F.count("*").alias("n"))
    r = fixtures.recordings(spark, sf_dir).join(rows, "recording_id")
    return r.select("recording_id", F.date_format(C.recorded_at(F.col("name")), "yyyy-MM-dd HH:mm:ss").alias("at"), C.display_name(F.col("name")).alias("display"), "n")


@query(" SELECT recording_id, track_id, CASE motility_phenotype WHEN 0 THEN 'immotile' WHEN 1 THEN 'twitching' ELSE 'motile' END AS phenotype FROM stats")
def f8_phenotype_name(spark, sf_dir):
    one = found(spark, sf_dir).groupBy(*KEY).agg(F.first("motility_phenotype").alias("p"))
    return one.select(*KEY, C.phenotype_name(F.col("p")).alias("phenotype"))


@query(
    """ SELECT recording_id, track_id, position_t,
    CASE WHEN position_x < min(position_x) OVER (k ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AND position_x < min(position_x) OVER (k ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) THEN position_x ELSE -1 END AS low,
    CASE WHEN degrees_angle = max(degrees_angle) OVER (k ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) THEN degrees_angle ELSE 0 END AS high
    FROM tracks WINDOW k AS (PARTITION BY recording_id, track_id ORDER BY position_t)"""
)
def x2_local_extremes(spark, sf_dir):
    low, high = C.local_extreme("position_x", least=True, strict=True, fill=-1.0), C.local_extreme("degrees_angle", fill=0.0)
    return fixtures.tracks(spark, sf_dir).select(*KEY, "position_t", low.alias("low"), high.alias("high"))


@query(f" SELECT {_T} FROM tracks")
def o1_sort_tracks(spark, sf_dir):
    return select.sort_tracks(fixtures.tracks(spark, sf_dir))


@query(" SELECT recording_id, fps, frame_height, frame_width, frame_count, n FROM recordings JOIN (SELECT recording_id, count(*) AS n FROM tracks GROUP BY 1) USING (recording_id)")
def f9_parse_metadata(spark, sf_dir):
    rows = fixtures.tracks(spark, sf_dir).groupBy("recording_id").agg(F.count("*").alias("n"))
    text = F.to_json(F.struct("fps", "frame_height", "frame_width", "frame_count"))
    return fixtures.recordings(spark, sf_dir).select("recording_id", files.parse_metadata(text).alias("m")).join(rows, "recording_id").select("recording_id", "m.*", "n")


_scratch = scratch


@query(f" SELECT {_T} FROM selected")
def s4_write_and_read(spark, sf_dir):
    where = files.write_stage(select.select_tracks(prepared(spark, sf_dir), S), _scratch(spark), "selected")
    return spark.read.parquet(where).select(*[F.col(c).cast("long") if c in KEY else F.col(c) for c in TRACK_COLUMNS])


@query(" SELECT name, count(*) AS n, round(sum(position_x), 4) AS sum_x, CAST(sum(position_t) AS BIGINT) AS sum_t FROM tracks JOIN (SELECT DISTINCT recording_id, 'r' || recording_id AS name FROM tracks) USING (recording_id) GROUP BY 1")
def s1_read_tracks(spark, sf_dir):
    rows = fixtures.tracks(spark, sf_dir)
    where = _scratch(spark)
    csv = rows.select(F.concat(F.lit("r"), "recording_id").alias("folder"), *[F.col(c).alias(c.upper()) for c in TRACK_COLUMNS[1:]], F.lit(None).cast("double").alias("ILLUMINATION"))
    files.by_folder(csv, "folder").write.partitionBy("folder").option("header", True).csv(where)
    # Each folder is a recording, which may have several part files.
    raw = files.read_tracks(spark, where, suffix=".csv", by="folder", recursive=True).withColumn("path", F.input_file_name())
    name = F.regexp_extract(F.first("path"), r"folder=(\w+)", 1)
    out = raw.groupBy("recording_id").agg(name.alias("name"), F.count("*").alias("n"), F.round(F.sum("position_x"), 4).alias("sum_x"), F.sum("position_t").alias("sum_t"))
    return out.drop("recording_id")


_STATISTICS = ("distance_um", "speed_um_s", "time_s")


@query(" SELECT v.name AS folder, count(*) AS n, " + ", ".join(f"round(sum(round({c}, 6)), 3) AS {c}" for c in _STATISTICS) + " FROM stats JOIN (SELECT DISTINCT recording_id, 'r' || recording_id AS name FROM tracks) v USING (recording_id) GROUP BY 1")
def s6_collate_statistics(spark, sf_dir):
    rows = rounded(stats(spark, sf_dir).select(F.concat(F.lit("r"), "recording_id").alias("folder"), "track_id", *_STATISTICS))
    where = _scratch(spark)
    files.by_folder(rows, "folder").write.partitionBy("folder").option("header", True).csv(f"{where}/all_statistics.csv")
    schema = "track_id long, " + ", ".join(f"{c} double" for c in _STATISTICS)
    raw = files.collate_statistics(spark, where, schema, pattern="*.csv").withColumn("path", F.input_file_name())
    return raw.groupBy(F.regexp_extract("path", r"folder=(\w+)", 1).alias("folder")).agg(F.count("*").alias("n"), *[F.round(F.sum(c), 3).alias(c) for c in _STATISTICS])


@query(" , t AS (SELECT *, recording_id AS k FROM recordings WHERE recording_id IN (SELECT recording_id FROM tracks)) SELECT name, CASE k % 4 WHEN 0 THEN 'finished' WHEN 1 THEN 'evaluate' WHEN 2 THEN 'select' ELSE 'track' END AS stage, n FROM t JOIN (SELECT recording_id, count(*) AS n FROM tracks GROUP BY 1) USING (recording_id)")
def s7_classify_stage(spark, sf_dir):
    endings = F.array(*[F.lit(e) for e in ("_analysed.csv", "_selected_data.csv", "_list.csv", ".avi")])
    rows = fixtures.tracks(spark, sf_dir).groupBy("recording_id").agg(F.count("*").alias("n"))
    path = F.concat("name", F.element_at(endings, (F.col("recording_id") % 4 + 1).cast("int")))
    return fixtures.recordings(spark, sf_dir).join(rows, "recording_id").select("name", files.classify_stage(path).alias("stage"), "n")


@query(f" SELECT {_T} FROM tracks WHERE recording_id <> 1 UNION ALL SELECT {_T} FROM clean WHERE recording_id = 1")
def s5_overwrite_recordings(spark, sf_dir):
    where = _scratch(spark)
    files.write_stage(fixtures.tracks(spark, sf_dir), where, "rows")
    one = select.clean_rows(prepared(spark, sf_dir).where("recording_id = 1"), S).select(*TRACK_COLUMNS)
    where = files.write_stage(one, where, "rows", mode="overwrite")
    return spark.read.parquet(where).select(*[F.col(c).cast("long") if c in KEY else F.col(c) for c in TRACK_COLUMNS])


@query(f" SELECT 'first' AS version, {_T} FROM tracks UNION ALL SELECT 'latest', {_T} FROM clean")
def s5_versions(spark, sf_dir):
    where = _scratch(spark)
    files.write_version(fixtures.tracks(spark, sf_dir), where, "rows", "a")
    files.write_version(select.clean_rows(prepared(spark, sf_dir), S).select(*TRACK_COLUMNS), where, "rows", "b")
    both = [files.read_version(spark, where, "rows", run).select(F.lit(name).alias("version"), *TRACK_COLUMNS) for name, run in (("first", "a"), ("latest", None))]
    return both[0].unionByName(both[1])


@query(" SELECT recording_id, track_id, count(*) AS n, CAST(sum(position_t) AS BIGINT) AS sum_t FROM tracks WHERE recording_id % 2 = 0 GROUP BY 1, 2")
def s2_find_files(spark, sf_dir):
    # Only recordings with even ids have files of the wanted ending, each in a folder below.
    where, rows = _scratch(spark), fixtures.tracks(spark, sf_dir).withColumn("folder", F.col("recording_id"))
    for name, part in (("lists", rows.where("folder % 2 = 0")), ("other", rows)):
        files.by_folder(part, "folder").write.partitionBy("folder").option("header", True).option("compression", "none" if name == "lists" else "gzip").csv(f"{where}/{name}")
    schema = ", ".join(f"{c} {'long' if c in (*KEY, 'position_t') else 'double'}" for c in TRACK_COLUMNS)
    found = files.find_files(spark, where, suffix=".csv", recursive=True, modified_after="2000-01-01T00:00:00").schema(schema).option("header", True).csv(where)
    return found.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum("position_t").alias("sum_t"))


@query(" SELECT 'r' || recording_id AS name, fps, CAST(frame_height AS INT) AS frame_height, CAST(1000 AS INT) AS frame_width, frame_count, n FROM recordings JOIN (SELECT recording_id, count(*) AS n FROM tracks GROUP BY 1) USING (recording_id)")
def s3_read_recordings(spark, sf_dir):
    # Sidecars and tracks of a recording lie in one folder and are joined by it.
    where, meta = _scratch(spark), fixtures.recordings(spark, sf_dir)
    name = F.concat(F.lit("r"), "recording_id").alias("folder")
    rows = fixtures.tracks(spark, sf_dir).select(name, *[F.col(c).alias(c.upper()) for c in TRACK_COLUMNS[1:]], F.lit(None).cast("double").alias("ILLUMINATION"))
    files.by_folder(rows, "folder").write.partitionBy("folder").option("header", True).csv(where)
    lines = meta.select(name, F.to_json(F.struct("fps", "frame_height", "frame_width", "frame_count")).alias("value"))
    files.by_folder(lines, "folder").write.partitionBy("folder").mode("append").text(where)
    raw = files.read_recordings(spark, where, overrides={"frame_width": 1000}, by="folder", recursive=True, ending=".txt")
    counts = files.read_tracks(spark, where, suffix=".csv", by="folder", recursive=True).withColumn("path", F.input_file_name())
    counts = counts.groupBy("recording_id").agg(F.regexp_extract(F.first("path"), r"folder=(\w+)", 1).alias("folder"), F.count("*").alias("n"))
    return raw.join(counts, "recording_id").select(F.col("folder").alias("name"), "fps", "frame_height", "frame_width", "frame_count", "n")


def _tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = select.with_recording(fixtures.detections(fixtures.tracks(spark, sf_dir)), fixtures.recordings(spark, sf_dir), S)
    return seen.withColumn("frame_count", F.lit(None).cast("long"))


#: The walk over the frames of each recording, whose state is one row with the list of living objects.
_WALK = """ , seen AS MATERIALIZED (SELECT recording_id, frame, list({'x': x, 'y': y, 'w': width, 'h': height, 'a': degrees_angle} ORDER BY det_id) AS dets FROM detections GROUP BY 1, 2),
    ends AS MATERIALIZED (SELECT s.recording_id, min(frame) AS first, max(frame) AS last, CAST(round_even(any_value(p.fps), 0) AS BIGINT) AS most FROM seen s JOIN (SELECT recording_id, any_value(fps) AS fps FROM prepared GROUP BY 1) p USING (recording_id) GROUP BY 1),
    walk AS (
      SELECT recording_id, first - 1 AS frame, CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, a DOUBLE, m BIGINT)[]) AS objs, CAST(0 AS BIGINT) AS next_id FROM ends
      UNION ALL
      SELECT recording_id, frame, list_concat(list_filter(moved, lambda o: o.m <= most), born) AS objs, next_id + len(born) AS next_id FROM (
        SELECT *, list_transform(objs, lambda o, k: CASE
            WHEN wins[near[k].i].k = k THEN {'id': o.id, 'x': dets[near[k].i].x, 'y': dets[near[k].i].y, 'w': dets[near[k].i].w, 'h': dets[near[k].i].h, 'a': dets[near[k].i].a, 'm': CAST(0 AS BIGINT)}
            WHEN len(dets) > len(objs) THEN o
            ELSE {'id': o.id, 'x': o.x, 'y': o.y, 'w': CAST(0 AS DOUBLE), 'h': CAST(0 AS DOUBLE), 'a': CAST(0 AS DOUBLE), 'm': o.m + 1} END) AS moved,
          CASE WHEN len(dets) > len(objs) THEN list_transform(list_filter(range(1, len(dets) + 1), lambda i: wins[i] IS NULL),
            lambda i, j: {'id': next_id + j - 1, 'x': dets[i].x, 'y': dets[i].y, 'w': dets[i].w, 'h': dets[i].h, 'a': dets[i].a, 'm': CAST(0 AS BIGINT)}) ELSE [] END AS born
        FROM (
          SELECT *, list_transform(range(1, len(dets) + 1), lambda i: list_min(list_filter(list_transform(near, lambda n, k: CASE WHEN n.i = i THEN {'d': n.d, 'k': k} END), lambda n: n IS NOT NULL))) AS wins
          FROM (
            SELECT *, list_transform(objs, lambda o: list_min(list_transform(dets, lambda e, i: {'d': sqrt((o.x - e.x) * (o.x - e.x) + (o.y - e.y) * (o.y - e.y)), 'i': i}))) AS near
            FROM (SELECT w.recording_id, w.frame + 1 AS frame, w.objs, w.next_id, e.most, coalesce(s.dets, []) AS dets
              FROM walk w JOIN ends e USING (recording_id) LEFT JOIN seen s ON s.recording_id = w.recording_id AND s.frame = w.frame + 1 WHERE w.frame < e.last))))) 
    SELECT recording_id, o.id AS track_id, frame AS position_t, round(o.x, 6) AS position_x, round(o.y, 6) AS position_y, o.w AS width, o.h AS height, o.a AS degrees_angle FROM (SELECT recording_id, frame, unnest(objs) AS o FROM walk)"""


@query(_WALK)
def t1_track(spark, sf_dir):
    return rounded(tracking.track(_tracked(spark, sf_dir)))


@query(_WALK)
def t1_track_in_slices(spark, sf_dir):
    return rounded(slices.track_in_slices(_tracked(spark, sf_dir), 200))


@query()
def t1_track_filtered(spark, sf_dir):
    return rounded(tracking.track(_tracked(spark, sf_dir), S))


def _line(c: str, n: int) -> str:
    """The next value on the line through the last n of the 30 values in ``c``."""
    return f"list_sum(list_transform({c}[{31 - n}:30], lambda v, k: v * 2 * (3 * (k - 1) - {n - 1}) / {n * (n - 1)}))"


#: The filters' predictions come from windows; their weights are walked row by row.
_FILTERED = (
    """ , padded AS (SELECT *, list_concat(list_transform(range(30 - len(bx)), lambda i: first_x), bx) AS px, list_concat(list_transform(range(30 - len(bx)), lambda i: first_y), bz) AS py
      FROM (SELECT recording_id, track_id, position_t, position_x AS x, position_y AS y, row_number() OVER k - 1 AS t, first(position_x) OVER k AS first_x, first(position_y) OVER k AS first_y,
        coalesce(list(position_x) OVER b, []) AS bx, coalesce(list(position_y) OVER b, []) AS bz FROM tracks WHERE width > 0
        WINDOW k AS (PARTITION BY recording_id, track_id ORDER BY position_t), b AS (PARTITION BY recording_id, track_id ORDER BY position_t ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))),
    guesses AS MATERIALIZED (SELECT recording_id, track_id, position_t, t, x, y, """
    + ", ".join(f"CASE WHEN t >= {n - 10} THEN {_line(f'p{a}', n)} ELSE 0 END AS {a}{n}" for n in (10, 20, 30) for a in "xy")
    + """ FROM padded),
    likely AS MATERIALIZED (SELECT *, """
    + ", ".join(f"greatest(exp(-0.5 * ((x - x{n}) * (x - x{n}) + (y - y{n}) * (y - y{n}))), 1e-20) AS l{n}" for n in (10, 20, 30))
    + """ FROM guesses),
    weights AS (
      SELECT recording_id, track_id, t, CAST(1 AS DOUBLE) AS w10, CAST(0 AS DOUBLE) AS w20, CAST(0 AS DOUBLE) AS w30 FROM likely WHERE t = 0
      UNION ALL
      SELECT recording_id, track_id, t, w10 / total, w20 / total, w30 / total FROM (SELECT *, w10 + w20 + w30 AS total FROM (
        SELECT l.recording_id, l.track_id, l.t, l.l10 * CASE WHEN l.t = 10 THEN 1.0 / 2 WHEN l.t = 20 THEN 1.0 / 3 ELSE w.w10 END AS w10,
          l.l20 * CASE WHEN l.t = 10 THEN 1.0 / 2 WHEN l.t = 20 THEN 1.0 / 3 ELSE w.w20 END AS w20, l.l30 * CASE WHEN l.t = 20 THEN 1.0 / 3 ELSE w.w30 END AS w30
        FROM weights w JOIN likely l ON l.recording_id = w.recording_id AND l.track_id = w.track_id AND l.t = w.t + 1)))
    SELECT recording_id, track_id, position_t, x AS position_x, y AS position_y, round(w10 * x10 + w20 * x20 + w30 * x30, 4) AS filtered_x, round(w10 * y10 + w20 * y20 + w30 * y30, 4) AS filtered_y
    FROM guesses JOIN weights USING (recording_id, track_id, t)"""
)


@query(_FILTERED)
def t4_gsff(spark, sf_dir):
    return rounded(tracking.gsff(fixtures.tracks(spark, sf_dir).where("width > 0"), S), 4)


def _streamed(spark: SparkSession, df_of: Callable[[DataFrame], DataFrame], rows: DataFrame) -> DataFrame:
    """Write rows as a table, read it as a stream through ``df_of`` and return what it wrote."""
    where = _scratch(spark)
    rows.write.parquet(f"{where}/in")
    out = df_of(spark.readStream.schema(rows.schema).parquet(f"{where}/in"))
    jobs.write_stream(out, f"{where}/out", f"{where}/checkpoint").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{where}/out")


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select((F.col("user_id") % 8).alias("recording_id"), F.col("user_id").alias("track_id"), F.col("ts").cast("timestamp").alias("ts"), F.round("value", 2).alias("step"), F.col("event_id").alias("det_id"))


_LATE = "(SELECT max(ts) - INTERVAL 10 SECOND FROM events)"


@query(f" SELECT user_id % 8 AS recording_id, user_id AS track_id, epoch_us(date_trunc('second', ts)) AS second, round(sum(round(value, 2)), 4) AS path, count(*) AS n FROM events GROUP BY 1, 2, 3 HAVING max(date_trunc('second', ts)) + INTERVAL 1 SECOND <= {_LATE}")
def t6_speed_per_second(spark, sf_dir):
    out = _streamed(spark, jobs.speed_per_second, _event_rows(spark, sf_dir))
    return out.select("recording_id", "track_id", F.unix_micros("second").alias("second"), F.round("path", 4).alias("path"), "n")


@query(
    f""" SELECT recording_id, track_id, count(*) AS n_rows, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS stop_us FROM (SELECT *, sum(cut) OVER (PARTITION BY recording_id, track_id ORDER BY ts, event_id) AS s FROM
    (SELECT event_id, user_id % 8 AS recording_id, user_id AS track_id, ts, gap, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= gap THEN 1 ELSE 0 END AS cut
     FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 20 MINUTE END AS gap FROM events)))
    GROUP BY 1, 2, s HAVING max(ts) + any_value(gap) <= {_LATE}"""
)
def t7_fragments_stream(spark, sf_dir):
    # Two rates in one stream: holes of 5.5 frames last an hour in one half of the recordings, 20 minutes in the other.
    rows = _event_rows(spark, sf_dir).withColumn("fps", F.when(F.col("recording_id") % 2 == 0, 5.5 / 3600).otherwise(5.5 / 1200))
    out = _streamed(spark, lambda d: jobs.fragments_stream(d, jobs.hole_gap(S)), rows)
    return out.select("recording_id", "track_id", "n_rows", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("stop_ts").alias("stop_us"))


@query(" SELECT user_id % 8 AS recording_id, 0 AS frame, event_id AS det_id FROM events")
def t9_dedupe_stream(spark, sf_dir):
    rows = _event_rows(spark, sf_dir).withColumn("frame", F.lit(0))
    return _streamed(spark, jobs.dedupe_stream, rows.union(rows)).select("recording_id", "frame", "det_id")


@query(
    f""" SELECT recording_id, epoch_us(until) AS until_us, CAST(sum(v) // (1000000 * count(*)) AS INT) AS threshold FROM (SELECT user_id % 8 AS recording_id, date_trunc('second', ts) - to_seconds(k) + INTERVAL 5 SECOND AS until, CAST(round((round(value, 2) + 3.0) * 1e6) AS BIGINT) AS v
    FROM events, range(5) r(k)) GROUP BY recording_id, until HAVING until <= {_LATE}"""
)
def t8_threshold_stream(spark, sf_dir):
    rows = _event_rows(spark, sf_dir).select("recording_id", "ts", F.col("step").alias("grey_mean"), F.lit(1.0).alias("grey_std"))
    return _streamed(spark, lambda d: jobs.threshold_stream(d, 2.0), rows).select("recording_id", F.unix_micros("at").alias("until_us"), "threshold")


@query(f" SELECT {_T} FROM selected")
def x3_run_pipeline(spark, sf_dir):
    return pipeline.run_pipeline(fixtures.tracks(spark, sf_dir), fixtures.recordings(spark, sf_dir), S, stop_after="select").selected


@query()
def x3_from_detections(spark, sf_dir):
    d = fixtures.detections(fixtures.tracks(spark, sf_dir))
    return rounded(pipeline.run_pipeline(d, fixtures.recordings(spark, sf_dir), S, start_at="track", stop_after="summarise").summary)


@query(_WALK)
def t2_track_stream(spark, sf_dir):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    d = fixtures.detections(fixtures.tracks(spark, sf_dir))
    ends = d.groupBy("recording_id").agg((F.max("frame") + 1).alias("frame"))
    d = d.unionByName(ends, allowMissingColumns=True).join(fixtures.recordings(spark, sf_dir).select("recording_id", "fps"), "recording_id", "left")
    return rounded(_streamed(spark, jobs.track_stream, d))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far and how fast did each track go?"""
    rows = select.clean_rows(prepared(spark, sf_dir), S)
    return rounded(evaluate.track_stats(evaluate.features(rows, S)))
