"""The tracker, the filters and the hull against plain versions written from the specification."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrack.operators import evaluate, linking, tracking
from kinetrack.settings import Settings

COLUMNS = "recording_id long, frame long, det_id long, x double, y double, width double, height double, degrees_angle double, fps double, frame_count long"


class PlainFilter:
    def __init__(self, lengths):
        self.n, self.mode, self.history = lengths, 0, []
        self.weights, self.preds = [0.0] * len(lengths), [(0.0, 0.0)] * len(lengths)

    def line(self, n, d):
        ys = [p[d] for p in self.history[-n:]]
        ks = np.arange(n)
        slope, base = np.polyfit(ks, ys, 1)
        return slope * n + base

    def correct(self, m):
        if not self.history:
            self.history = [m] * self.n[0]
        before = self.mode
        while self.mode < len(self.n) and len(self.history) >= self.n[self.mode]:
            self.mode += 1
        if self.mode != before:
            self.weights = [1 / self.mode if i < self.mode else 0.0 for i in range(len(self.n))]
            self.preds = [(self.line(n, 0), self.line(n, 1)) if i < self.mode else (0.0, 0.0) for i, n in enumerate(self.n)]
        like = [max(math.exp(-0.5 * ((m[0] - p[0]) ** 2 + (m[1] - p[1]) ** 2)), 1e-20) for p in self.preds]
        self.history = (self.history + [m])[-(self.n[-1] + 1) :]
        raw = [a * b for a, b in zip(like, self.weights, strict=True)]
        self.weights = [v / sum(raw) for v in raw]
        return tuple(sum(w * p[d] for w, p in zip(self.weights, self.preds, strict=True)) for d in (0, 1))

    def predict(self):
        self.preds = [(self.line(n, 0), self.line(n, 1)) if i < self.mode else (0.0, 0.0) for i, n in enumerate(self.n)]
        return tuple(sum(w * p[d] for w, p in zip(self.weights, self.preds, strict=True)) for d in (0, 1))


def plain_tracker(frames, max_missed, lengths=None):
    """frames: {frame: [(x, y, w, h, a)]} with every frame present."""
    objects, rows, next_id = [], [], 0
    for f in sorted(frames):
        dets = frames[f]

        def miss(lost):
            for o in lost:
                o["missed"] += 1
                o["extra"] = (0.0, 0.0, 0.0)
            objects[:] = [o for o in objects if o["missed"] <= max_missed]

        def register(d):
            nonlocal next_id
            objects.append({"id": next_id, "pos": d[:2], "extra": d[2:], "missed": 0, "f": PlainFilter(lengths) if lengths else None})
            next_id += 1

        if not dets:
            miss(list(objects))
        elif not objects:
            for d in dets:
                register(d)
        else:
            n = len(objects)
            near = [min(range(len(dets)), key=lambda j: (math.dist(o["pos"], dets[j][:2]), j)) for o in objects]
            used, matched = set(), set()
            for i in sorted(range(n), key=lambda i: (math.dist(objects[i]["pos"], dets[near[i]][:2]), i)):
                if near[i] not in used:
                    used.add(near[i])
                    matched.add(i)
                    objects[i].update(pos=dets[near[i]][:2], extra=dets[near[i]][2:], missed=0)
            if n >= len(dets):
                miss([o for i, o in enumerate(objects) if i not in matched])
            else:
                for j in range(len(dets)):
                    if j not in used:
                        register(dets[j])
        for o in objects:
            out = o["pos"]
            if lengths:
                out = o["f"].correct(o["pos"])
                o["pos"] = o["f"].predict()
            rows.append((o["id"], f, *out, *o["extra"]))
    return rows


def random_frames(seed, n_frames=60, objects=5):
    r = random.Random(seed)
    at = [(r.uniform(0, 100), r.uniform(0, 100)) for _ in range(objects)]
    frames = {}
    for f in range(n_frames):
        at = [(x + r.gauss(0.5, 0.5), y + r.gauss(0, 0.5)) for x, y in at]
        hidden = r.random() < 0.1
        frames[f] = [] if hidden else [(x, y, 2.0 + i, 5.0, 10.0) for i, (x, y) in enumerate(at) if r.random() > 0.15]
    first = next(f for f in frames if frames[f])
    return {f - first: d for f, d in frames.items() if f >= first}


@pytest.mark.parametrize("filtered", [False, True])
def test_tracker_equals_plain_version(spark, filtered):
    s = Settings(max_horizon=9) if filtered else None
    rows, want = [], []
    for rec in range(3):
        frames = random_frames(rec)
        rows += [(rec, f, k, *d, 4.0, len(frames)) for f, ds in frames.items() for k, d in enumerate(ds)]
        want += [(rec, *r) for r in plain_tracker(frames, 4, tracking.horizons(3, 0, 9) if filtered else None)]
    got = tracking.track(spark.createDataFrame(rows, COLUMNS), s).collect()
    key = lambda r: (r[0], r[1], r[2])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3:] for r in got], [r[3:] for r in want], atol=1e-6)


def test_object_found_again_and_expired(spark):
    seen = [(0, f, 0, 1.0 * f, 0.0, 2.0, 5.0, 0.0, 3.0, 20) for f in (0, 1, 5, 6, 15)]
    rows = tracking.track(spark.createDataFrame(seen, COLUMNS)).orderBy("position_t").collect()
    assert [(r.track_id, r.position_t) for r in rows] == [(0, t) for t in range(10)][:10] + [(1, t) for t in range(15, 19)]
    assert [r.width for r in rows[:7]] == [2, 2, 0, 0, 0, 2, 2]


def test_line_weights_are_least_squares():
    for n in (2, 10, 30):
        y = np.random.default_rng(n).normal(size=n)
        slope, base = np.polyfit(np.arange(n), y, 1)
        assert abs(tracking.line_weights(n) @ y - (slope * n + base)) < 1e-9
    with pytest.raises(ValueError):
        tracking.line_weights(1)


def test_hull_diameter_is_the_largest_pair():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50):
        p = rng.normal(size=(n, 2))
        want = max(math.dist(a, b) for a in p for b in p)
        assert abs(evaluate.hull_diameter(p[:, 0], p[:, 1]) - want) < 1e-9
    assert evaluate.hull_diameter(np.ones(5), np.arange(5.0)) == 4


def test_gsff_equals_plain_version(spark):
    r = random.Random(3)
    points = [(t * 0.7 + r.gauss(0, 0.3), r.gauss(0, 0.3)) for t in range(40)]
    df = spark.createDataFrame([(1, 1, t, x, y) for t, (x, y) in enumerate(points)], "recording_id long, track_id long, position_t long, position_x double, position_y double")
    got = tracking.gsff(df, Settings(max_horizon=12)).orderBy("position_t").select("filtered_x", "filtered_y").collect()
    plain = PlainFilter(tracking.horizons(3, 0, 12))
    want = []
    for p in points:
        want.append(plain.correct(p))
        plain.predict()
    assert np.allclose([tuple(g) for g in got], want, atol=1e-6)


def test_tracks_are_filtered_together(spark, monkeypatch):
    """Tracks of all lengths in one lockstep walk, ten times as fast as one by one, whatever the batches."""
    r, lengths = random.Random(17), tracking.horizons(3, 0, 12)
    tracks = {(i % 3, i): [(100 + r.uniform(-9, 9) + k, 50 + r.uniform(-9, 9)) for k in range(r.choice((1, 2, 15, 40, 150)))] for i in range(300)}
    want = {}
    for key, points in list(tracks.items())[:60]:
        plain = PlainFilter(lengths)
        want[key] = []
        for p in points:
            want[key].append(plain.correct(p))
            plain.predict()
    rows = [(*key, t, *p) for key, points in tracks.items() for t, p in enumerate(points)]
    df = spark.createDataFrame(rows, "recording_id long, track_id long, position_t long, position_x double, position_y double").repartition(3)
    got = {}
    for x in tracking.gsff(df, Settings(max_horizon=12)).orderBy("position_t").collect():
        got.setdefault((x.recording_id, x.track_id), []).append((x.filtered_x, x.filtered_y))
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in tracks.items()}
    assert all(np.allclose(got[k], v, atol=1e-6) for k, v in want.items())
    assert tracking.gsff(df.limit(0), Settings()).count() == 0

    at = np.concatenate([np.array(v) for v in tracks.values()])
    first = np.concatenate([[0], np.cumsum([len(v) for v in tracks.values()])])
    begin = time.monotonic()
    together = tracking.filter_together(at, first, lengths)
    middle = time.monotonic()
    alone = np.concatenate([tracking.filter_together(at[a:b], np.array([0, b - a]), lengths) for a, b in zip(first, first[1:], strict=False)])
    assert np.allclose(together, alone, atol=1e-9) and time.monotonic() - middle > 10 * (middle - begin)
    # Cut into small batches, tracks that go on in the next one are held back.
    import pyarrow as pa

    monkeypatch.setattr(tracking, "TOGETHER", 70)
    table = pa.table({"recording_id": [k[0] for k, v in tracks.items() for _ in v], "track_id": [k[1] for k, v in tracks.items() for _ in v], "position_t": [t for v in tracks.values() for t in range(len(v))], "position_x": at[:, 0], "position_y": at[:, 1]})
    parts = pa.Table.from_batches(list(tracking._filter(lengths)(iter(table.to_batches(max_chunksize=37)))))
    assert np.allclose(parts.column("filtered_x").to_numpy(), together[:, 0], atol=1e-9)


def test_streaming_tracker_equals_batch(spark, tmp_path):
    from kinetrack.streaming import jobs

    frames = {r: random_frames(r, 30, 3) for r in range(2)}
    rows = [(r, f, k, *d, 4.0, None) for r, fs in frames.items() for f, ds in fs.items() for k, d in enumerate(ds)]
    df = spark.createDataFrame(rows, COLUMNS).drop("fps", "frame_count")
    for part in range(3):
        df.where(F.col("frame").between(part * 10, part * 10 + 9)).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    # One more detection far ahead moves the watermark past all frames.
    spark.createDataFrame([(9, 10_000, 0, 0.0, 0.0, 1.0, 1.0, 0.0)], df.schema).write.parquet(f"{tmp_path}/in/9")
    source = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.write_stream(jobs.track_stream(source, 4.0), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").where("recording_id < 9")
    want = tracking.track(spark.createDataFrame(rows, COLUMNS))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_streaming_tracker_takes_rates_and_ends_recordings(spark, tmp_path):
    from kinetrack.streaming import jobs

    rows = [(r, f, k, *d, fps, None) for r, fps in ((0, 4.0), (1, 10.0)) for f, ds in random_frames(r, 30, 3).items() for k, d in enumerate(ds)]
    df = spark.createDataFrame(rows, COLUMNS).drop("frame_count")
    df.coalesce(1).write.parquet(f"{tmp_path}/in/0")
    # Far ahead: first to pass all frames, then to end the recordings, then recording 0 starts anew.
    for part, (r, f) in enumerate(((9, 1000), (9, 9000), (9, 9100), (0, 9200), (9, 20_000)), 1):
        spark.createDataFrame([(r, f, 0, 5.0, 5.0, 1.0, 1.0, 0.0, 4.0)], df.schema).write.parquet(f"{tmp_path}/in/{part}")
        time.sleep(0.1)  # files are taken by age
    source = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.write_stream(jobs.track_stream(source, idle=600.0), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").where("recording_id < 9")
    want = tracking.track(spark.createDataFrame(rows, COLUMNS))
    assert sorted(map(tuple, got.where("position_t < 100").collect())) == sorted(map(tuple, want.collect()))
    # What comes after the end has an id of its own.
    after = 1 + max(r.track_id for r in want.collect() if r.recording_id == 0)
    assert [tuple(r)[:3] for r in got.where("position_t >= 100").collect()] == [(0, after, 9200)]


def test_end_rows_close_streamed_recordings(spark, tmp_path):
    """Nothing waits in state once a recording's end has come, and its rows are those of the walk to the same frame."""
    from kinetrack.streaming import jobs

    counts = {0: 30, 1: 33, 2: 60}
    rows = [(r, f, k, *d, 4.0, counts[r]) for r in counts for f, ds in random_frames(r, 30, 3).items() for k, d in enumerate(ds)]
    df = spark.createDataFrame(rows, COLUMNS)
    df.where("frame < 20").drop("frame_count").coalesce(1).write.parquet(f"{tmp_path}/in/0")
    ends = spark.createDataFrame(list(counts.items()), "recording_id long, frame long").withColumn("fps", F.lit(4.0))
    time.sleep(0.1)
    df.where("frame >= 20").drop("frame_count").unionByName(ends, allowMissingColumns=True).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    source = spark.readStream.schema(df.drop("frame_count").schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.write_stream(jobs.track_stream(source), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, tracking.track(df).collect()))


def test_streamed_and_sliced_queries_give_the_batch_rows(spark):
    from kinetrack.plans import queries

    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, queries.QUERIES["t1_track"](spark, sf).collect()))
    assert sorted(map(tuple, queries.QUERIES["t2_track_stream"](spark, sf).collect())) == want
    assert sorted(map(tuple, queries.QUERIES["t1_track_in_slices"](spark, sf).collect())) == want


def test_markers_inside_turned_boxes(spark):
    names = "recording_id long, frame long, det_id long, x double, y double, width double, height double, degrees_angle double"
    boxes = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 10.0, 2.0, 0.0), (1, 0, 1, 50.0, 0.0, 10.0, 2.0, 90.0), (1, 1, 2, 0.0, 0.0, 10.0, 2.0, 0.0)], names)
    marks = spark.createDataFrame([(1, 0, 0, 4.0, 0.0, 1.0, 1.0, 0.0), (1, 0, 1, 50.0, 4.0, 1.0, 1.0, 0.0)], names)
    assert {r.det_id for r in linking.keep_marked(boxes, marks).collect()} == {0, 1}


def test_links_are_those_of_all_pairs(spark):
    """Dense frames, lone detections, frames on a line or a point, and the next frame missing."""
    r, rows = random.Random(29), []
    for f, (n, size) in enumerate(((120, 40), (90, 40), (3, 3000), (5, 3000), (1, 1), (40, 0), (40, 900), (0, 1), (8, 50), (8, 5000))):
        rows += [(1, f, k, r.uniform(0, size), r.uniform(0, size) if f != 6 else 7.0) for k in range(n)]
    want = {}
    for _, f, k, x, y in rows:
        near = min(((math.sqrt((bx - x) ** 2 + (by - y) ** 2), b) for _, g, b, bx, by in rows if g == f + 1), default=None)
        if near and (near[0], k) < want.get((f, near[1]), (math.inf, 0)):
            want[f, near[1]] = (near[0], k)
    df = spark.createDataFrame(rows, "recording_id long, frame long, det_id long, x double, y double")
    got = {(x.frame, x.next_id): (x.distance, x.det_id) for x in linking.link_consecutive(df).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0]) for k in want)
    assert linking.link_consecutive(df.limit(0)).count() == 0


def test_marked_boxes_are_those_of_all_pairs(spark):
    """Boxes from a point to more than the frame, at all angles, over cells of many sizes."""
    r = random.Random(23)
    names = "recording_id long, frame long, det_id long, x double, y double, width double, height double, degrees_angle double"
    boxes = [(1, f, k, r.uniform(-50, 300), r.uniform(-50, 300), *(r.choice((0.0, 0.5, 3.0, 8.0, 40.0, 700.0)) for _ in range(2)), r.choice((0.0, 90.0, r.uniform(-180, 180)))) for f in range(6) for k in range(120)]
    boxes += boxes[:5] + [(1, 0, 900, None, 1.0, 5.0, 5.0, 0.0), (1, 0, 901, 5.0, 1.0, 5.0, None, 0.0)]
    marks = [(1, f, k, *((b[3], b[4]) if r.random() < 0.2 and b[3] is not None else (r.uniform(-50, 300), r.uniform(-50, 300))), 1.0, 1.0, 0.0) for f in range(5) for k in range(40) for b in [r.choice(boxes)]]
    marks += [(1, 1, 99, None, None, 1.0, 1.0, 0.0), marks[0]]
    want = []
    for b in boxes:
        if None not in b:
            a = math.radians(b[7])
            for m in marks:
                if m[1] == b[1] and m[3] is not None:
                    dx, dy = m[3] - b[3], m[4] - b[4]
                    if abs(dx * math.cos(a) + dy * math.sin(a)) <= b[5] / 2 and abs(dy * math.cos(a) - dx * math.sin(a)) <= b[6] / 2:
                        want.append(b[:3])
                        break
    got = linking.keep_marked(spark.createDataFrame(boxes, names), spark.createDataFrame(marks, names)).collect()
    assert sorted(tuple(x)[:3] for x in got) == sorted(want) and 50 < len(want) < len(boxes)
    assert linking.keep_marked(spark.createDataFrame([], names), spark.createDataFrame(marks, names)).count() == 0


def test_brightness_is_a_third_coordinate(spark):
    # Two objects swap places in one frame; only their brightness tells them apart.
    rows = [(1, t, i, 10.0 + (i if t < 5 else 1 - i) * 0.2, 10.0, 2.0, 5.0, 0.0, 10.0, None, float(2 * i)) for t in range(10) for i in range(2)]
    df = spark.createDataFrame(rows, COLUMNS + ", illumination double")
    got = tracking.track(df, luminosity=True).collect()
    assert len(got) == 20 and all(r.illumination == 2 * r.track_id for r in got)
    plain = {(r.track_id, r.position_t): r.position_x for r in tracking.track(df).collect()}
    assert plain[(0, 9)] == 10.0  # without it the nearest place wins
    with pytest.raises(ValueError):
        tracking.track(df, Settings(), luminosity=True)
