"""Selection and evaluation on small tracks with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from kinetrack.operators import evaluate, select, summary
from kinetrack.schemas import TRACKS
from kinetrack.settings import Settings, odd_kernel

S = Settings(minimal_length_s=2, limit_length_s=0, area_quantile_percent=0, edge_percent=0, ratio_bounds=(0.1, 0.9), px_per_um=1.0)


def table(spark, tracks, fps=10.0):
    """tracks: {id: [(t, x, y) or (t, x, y, w, h)]}"""
    rows = [(1, i, t[0], float(t[1]), float(t[2]), *(map(float, t[3:]) if len(t) > 3 else (2.0, 5.0)), 0.0) for i, ts in tracks.items() for t in ts]
    return spark.createDataFrame(rows, TRACKS).withColumns({"fps": F.lit(fps), "frame_height": F.lit(922), "frame_width": F.lit(1228)})


def reasons(spark, tracks, s=S):
    return {r.track_id: r.reason for r in select.track_reasons(select.cut_tracks(table(spark, tracks), s), s).collect()}


def straight(n, x=100.0, y=100.0, start=0, v=1.0):
    return [(start + t, x + v * t, y) for t in range(n)]


def test_gap_of_five_holds_and_six_cuts(spark):
    five = [(t if t < 30 else t + 4, 100 + t, 100) for t in range(60)]
    six = [(t if t < 30 else t + 5, 100 + t, 100) for t in range(60)]
    cut = select.cut_tracks(table(spark, {1: five, 2: six}), S)
    assert {(r.track_id, r.n) for r in cut.groupBy("track_id").agg(F.countDistinct("fragment_id").alias("n")).collect()} == {(1, 1), (2, 2)}


def test_jump_is_removed_and_many_jumps_are_kept(spark):
    jump = straight(100)
    jump[50] = (50, 900.0, 900.0)
    cut = select.cut_tracks(table(spark, {1: jump, 2: straight(100), 3: straight(100)}), S)
    assert cut.where("outlier").count() == 2
    many = [(t, 100 + t + (300 if t % 8 == 0 else 0), 100) for t in range(100)]
    assert select.cut_tracks(table(spark, {1: many}), S).where("outlier").count() == 0


def test_reject_reasons(spark):
    got = reasons(spark, {1: straight(60), 3: [(t, 100 + t, 100, 3.2, 3.2) for t in range(60)], 5: [(t + t // 4, 100 + t, 100) for t in range(60)]})
    assert got == {1: 0, 3: 3, 5: 5}
    edge = Settings(**{**S.__dict__, "edge_percent": 5})
    assert reasons(spark, {1: straight(60), 2: straight(60, x=-20, v=0.1), 4: [(t, 100 + t, 440 + (480 if t in (20, 21) else 0)) for t in range(60)]}, edge)[2] == 2
    out = {1: [(t, 100.0, -2.0 + 10 * t) for t in range(60)]}
    assert reasons(spark, out, edge) == {1: 1}
    areas = Settings(**{**S.__dict__, "area_quantile_percent": 10})
    many = {i: [(t, 100 + t, 100, 2.0, 5 + (i - 5) / 10) for t in range(60)] for i in range(11)}
    rejected = {i for i, r in reasons(spark, many, areas).items() if r == 4}
    assert {0, 10} <= rejected <= {0, 1, 9, 10}  # tracks 1 and 9 are the quantiles themselves


def test_cut_reasons(spark):
    holes = [(t * 7, 100 + t, 100) for t in range(30)]  # enough rows, no run without holes
    assert reasons(spark, {1: holes}) == {1: 7}
    short = [(t * 30, 100 + t, 100) for t in range(10)]  # too few rows altogether
    assert reasons(spark, {1: short, 2: straight(60)})[1] == 8
    jumps = straight(42)
    for k in (14, 28):
        jumps[k] = (k, 900.0, 100.0)
    assert reasons(spark, {1: jumps, 2: straight(200), 3: straight(200)})[1] == 6


def test_fragments_equal_recursion(spark):
    """Splitting at the largest hole, then at the first outlier, again and again, leaves the same fragments."""

    def split(rows, least):
        gaps = [(rows[i][0] - rows[i - 1][0], i) for i in range(1, len(rows))]
        big = max(gaps, default=(0, 0), key=lambda g: (g[0], -g[1]))
        if len(rows) < least:
            return []
        if big[0] > 5:
            return split(rows[: big[1]], least) + split(rows[big[1] :], least)
        bad = next((i for i, r in enumerate(rows) if r[1]), None)
        if bad is not None:
            return split(rows[:bad], least) + split(rows[bad + 1 :], least)
        return [(rows[0][0], rows[-1][0], len(rows))]

    rng, rows, want = random.Random(5), [], set()
    for track in range(200):
        t, own = 0, []
        for _ in range(rng.randint(3, 40)):
            t += rng.choice([1, 1, 1, 1, 2, 5, 6, 9])
            own.append((t, rng.random() < 0.1))
        want |= {(track, *f) for f in split(own, 3)}
        rows += [(1, track, t, own[i][0] - own[i - 1][0] if i else None, o) for i, (t, o) in enumerate(own)]
    df = spark.createDataFrame(rows, "recording_id long, track_id long, position_t long, gap long, outlier boolean")
    cut = select.fragments(df, S).where("not outlier").groupBy("track_id", "fragment_id").agg(F.min("position_t"), F.max("position_t"), F.count("*").alias("n"))
    got = {(r[0], r[2], r[3], r[4]) for r in cut.collect() if r[4] >= 3}
    assert got == want


def test_longest_fragment_ties_go_to_the_earlier(spark):
    rows = [(t if t < 30 else t + 100, 100 + t, 100) for t in range(60)]
    s = Settings(**{**S.__dict__, "limit_length_s": 2})
    chosen = select.longest_fragment(select.fragment_profile(select.cut_tracks(table(spark, {1: rows}), s), s), s).collect()
    assert [(r.start_t, r.stop_t, r.limit_t) for r in chosen] == [(0, 19, 19)]


def test_limit_exactly_needs_the_row(spark):
    missing = [(t, 100 + t, 100) for t in range(60) if t != 19]
    s = Settings(**{**S.__dict__, "limit_length_s": 2, "limit_exactly": True, "max_empty_percent": 20})
    got = select.select_tracks(table(spark, {1: straight(60), 2: missing}), s)
    assert {r.track_id for r in got.select("track_id").distinct().collect()} == {1}


def test_results_do_not_depend_on_other_recordings(spark):
    a = table(spark, {1: straight(60), 2: straight(80, y=200)})
    b = table(spark, {3: straight(70, v=3.0)}).withColumn("recording_id", F.lit(2).cast("long"))
    one = select.select_tracks(a, S).collect()
    both = select.select_tracks(a.union(b), S).where("recording_id = 1").collect()
    assert sorted(one) == sorted(both)


def stats(spark, tracks, s=S):
    found = evaluate.features(table(spark, tracks), s)
    return found, {r.track_id: r for r in evaluate.track_stats(found).collect()}


def test_still_straight_and_circle(spark):
    import math

    circle = [(t, 200 + 40 * math.cos(t / 20), 200 + 40 * math.sin(t / 20)) for t in range(400)]
    found, got = stats(spark, {1: [(t, 5.0, 5.0) for t in range(100)], 2: straight(300), 3: circle})
    assert (got[1].distance_um, got[1].speed_um_s, got[1].arc_chord_ratio, got[1].motility_phenotype) == (0, 0, 0, 0)
    assert got[2].arc_chord_ratio == pytest.approx(1) and got[2].motility_phenotype == 2 and got[2].turn_points_per_s == 0
    assert found.where("track_id = 2 and position_t >= 10").agg(F.min("heading_deg"), F.max("heading_deg")).first() == (90.0, 90.0)
    assert got[3].displacement_um == pytest.approx(80, abs=0.1)
    assert all(r.arc_chord_ratio <= 1 + 1e-9 and r.displacement_um <= r.distance_um + 1e-9 for r in got.values())


def test_one_row_and_kernels(spark):
    _, got = stats(spark, {1: [(0, 1.0, 1.0)]})
    assert got[1].displacement_um == 0
    assert [odd_kernel(f) for f in (25, 30, 24.5)] == [25, 31, 25]


def test_recordings_without_metadata_keep_their_rows(spark):
    rows = table(spark, {1: straight(300), 2: [(t, 5.0, 5.0) for t in range(200)]})
    both = rows.union(rows.withColumn("recording_id", F.lit(7).cast("long"))).drop("fps", "frame_height", "frame_width")
    recordings = spark.createDataFrame([(1, 25.0, 922, 1228)], "recording_id long, fps double, frame_height int, frame_width int")
    got = evaluate.features(select.with_recording(both, recordings, Settings()), Settings())
    assert {(r.recording_id, r.fps): r["count"] for r in got.groupBy("recording_id", "fps").count().collect()} == {(1, 25.0): 500, (7, 30.0): 500}


def test_each_rate_has_its_own_windows(spark):
    """Rows windows of several rates in one pass give what each rate gives alone, and what plain Python gives."""
    import random

    r, rates = random.Random(4), (0.4, 5.0, 24.5, 25.0, 29.97, 30.0, 61.0)
    rows = [(i, 1, t, float(r.randrange(40)), float(r.randrange(3)), 3.0, 4.0, 0.0, fps) for i, fps in enumerate(rates) for t in range(r.randint(1, 160))]
    df = spark.createDataFrame(rows, "recording_id long, track_id long, position_t long, position_x double, position_y double, width double, height double, degrees_angle double, fps double")
    s = Settings(minimal_length_s=1, limit_length_s=3)
    got = evaluate.features(df, s).select("recording_id", "row_number", "moving_raw", "moving", "lag_displacement", "position_x", "position_y").orderBy("recording_id", "row_number").collect()
    for i, fps in enumerate(rates):
        own = [x for x in got if x.recording_id == i]
        def median(v, k):
            return [int(sum(v[max(0, n - k // 2) : n + k // 2 + 1]) > k // 2) for n in range(len(v))]
        assert [x.moving for x in own] == median(median([x.moving_raw for x in own], 3), odd_kernel(fps))
        n = s.lag_rows(fps)
        for k, x in enumerate(own):
            far = None if k < n else ((x.position_x - own[k - n].position_x) ** 2 + (x.position_y - own[k - n].position_y) ** 2) ** 0.5 / s.px_per_um
            assert x.lag_displacement == (far if far is None else pytest.approx(far)), (fps, k)


def test_settings_are_checked():
    for wrong in ({"fps": 0}, {"area_lower": 60}, {"filters": 1}, {"shape": "cube"}):
        with pytest.raises(ValueError):
            Settings(**wrong)
    assert summary.resolve_metric("SPEED") == "speed_um_s" and summary.resolve_metric("nothing") == "perc_motile"
    assert Settings().lag_rows(30) == 300 and Settings(minimal_length_s=5).lag_rows(25) == 62


def test_minimal_length_is_whole_frames(spark):
    # 2.55 s at 30 frames per second are 76 whole frames, not 76.5.
    s = Settings(minimal_length_s=2.55)
    df = spark.createDataFrame([(30.0,), (29.97,), (0.4,)], "fps double")
    assert [r[0] for r in df.select(select.min_rows(s)).collect()] == [76, 76, 0]


def test_seconds_are_counted_at_the_exact_rate(spark):
    # Row 58 is in the second second of a recording at 29.4 frames per second; at a whole rate of 29 it would be in the third.
    rows = [(1, 1, i, 1.0 if i < 30 else 5.0, 29.4) for i in range(60)]
    df = spark.createDataFrame(rows, "recording_id long, track_id long, position_t long, travelled_dist double, fps double")
    sums = {}
    for _, _, i, d, fps in rows:
        sums[int(i // fps)] = sums.get(int(i // fps), 0) + d
    import statistics

    assert evaluate.median_speed(df).first().median_speed == pytest.approx(statistics.median(sums.values()))
    assert evaluate.median_speed(df.withColumn("fps", F.lit(0.4))).count() == 1


def test_local_extremes(spark):
    from kinetrack.functions.columns import local_extreme

    values = [5.0, 3.0, 3.0, 4.0, 1.0, 6.0, 6.0, 2.0]
    df = spark.createDataFrame([(1, 1, i, v) for i, v in enumerate(values)], "recording_id long, track_id long, position_t long, v double")
    got = lambda **k: [r[0] for r in df.orderBy("position_t").select("position_t", local_extreme("v", 1, **k).alias("e")).orderBy("position_t").select("e").collect()]
    assert got(fill=0.0) == [5, 0, 0, 4, 0, 6, 6, 0]
    assert got(fill=-1.0, least=True) == [-1, 3, 3, -1, 1, -1, -1, 2]
    assert got(fill=-1.0, strict=True) == [-1, -1, -1, 4, -1, -1, -1, -1]
    assert got(fill=-1.0, strict=True, least=True) == [-1, -1, -1, -1, 1, -1, -1, -1]


def test_rows_are_sorted(spark):
    df = table(spark, {2: straight(5), 1: straight(5)}).orderBy(F.rand(1))
    assert [(r.track_id, r.position_t) for r in select.sort_tracks(df).collect()] == [(i, t) for i in (1, 2) for t in range(5)]


def test_settings_that_change_the_selection(spark):
    recordings = spark.createDataFrame([(1, 25.0, None, 10)], "recording_id long, fps double, frame_height int, frame_width int")
    rows = spark.createDataFrame([(1,)], "recording_id long")
    assert select.with_recording(rows, recordings, Settings(force_fps=True)).first().fps == 30.0
    cut = select.cut_tracks(table(spark, {1: [(t if t < 30 else t + 9, 100 + t, 100) for t in range(60)], 2: straight(60)}), Settings(**{**S.__dict__, "max_recursion_depth": 0}))
    assert {r.track_id for r in select.fragment_profile(cut, S).collect()} == {2}
    exact, near = (select.select_tracks(table(spark, {1: straight(60), 2: straight(80)}), S, accuracy).count() for accuracy in (None, 10_000))
    assert exact == near == 140


def test_all_stages_from_detections(spark):
    from kinetrack.plans.pipeline import run_pipeline

    rows = [(1, t, i, 100.0 + 40 * i + t, 100.0 + 30 * i, 2.0, 5.0, 0.0) for t in range(80) for i in range(3)]
    seen = spark.createDataFrame(rows, "recording_id long, frame long, det_id long, x double, y double, width double, height double, degrees_angle double")
    recordings = spark.createDataFrame([(1, 10.0, 922, 1228, 80), (2, 10.0, 922, 1228, 80)], "recording_id long, fps double, frame_height int, frame_width int, frame_count long")
    out = run_pipeline(seen, recordings, S, start_at="track")
    assert out.tracks.count() == 240 and out.selected.count() == 240 and out.failed.count() == 0
    assert out.stats.count() == 3 and out.summary.first().tracks == 3
    assert {round(r.arc_chord_ratio, 6) for r in out.stats.collect()} == {1.0}
    assert run_pipeline(seen, recordings, S, start_at="track", stop_after="track").selected is None


def nested_splits(rows, holes, limit, least):
    """Fragments (start, stop) that repeated splitting reaches. rows: (t, outlier)."""
    out = []

    def look(part, depth):
        if len(part) < least:
            return
        gaps = [b[0] - a[0] for a, b in zip(part, part[1:])]
        if gaps and max(gaps) > holes:
            k = gaps.index(max(gaps)) + 1
            parts = part[:k], part[k:]
        elif any(o for _, o in part):
            k = [o for _, o in part].index(True)
            parts = part[:k], part[k + 1 :]
        else:
            out.append((part[0][0], part[-1][0]))
            return
        if depth < limit:
            for p in parts:
                look(p, depth + 1)

    look(rows, 0)
    return sorted(out)


@pytest.mark.parametrize("limit", [1, 2, 3, 5, 960])
def test_depth_of_splitting(spark, limit):
    import random

    r, tracks = random.Random(31), {}
    for i in range(60):
        t, rows = 0, []
        for _ in range(r.randint(1, 60)):
            t += r.choice((1, 1, 1, 1, 2, 6, 7, 7, 9))
            rows.append((t, r.random() < 0.12))
        tracks[i] = rows
    flat = [(1, i, t, o, None if k == 0 else t - rows[k - 1][0]) for i, rows in tracks.items() for k, (t, o) in enumerate(rows)]
    df = spark.createDataFrame(flat, "recording_id long, track_id long, position_t long, outlier boolean, gap long")
    s = Settings(max_recursion_depth=limit)
    cut = select.fragments(df, s)
    cut = cut.withColumn("track_cuts", F.max("fragment_id").over(select.WT()))
    got = select.limit_depth(cut, s).where("not outlier and fragment_id is not null").groupBy("track_id", "fragment_id").agg(F.min("position_t").alias("a"), F.max("position_t").alias("b")).collect()
    for i, rows in tracks.items():
        assert sorted((x.a, x.b) for x in got if x.track_id == i) == nested_splits(rows, s.max_holes, limit, 1), (i, limit)
