"""What a task holds, and how many files are written, does not grow with the table."""

from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinetrack.operators import linking
from kinetrack.plans import queries
from kinetrack.sources import files, tables
from kinetrack.streaming import jobs

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_go_by_rows(spark, monkeypatch, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    for rows, tasks in ((10, 100), (1000, 4)):
        monkeypatch.setattr(tables, "TASK_ROWS", rows)
        assert tables.dealt(table, "id").rdd.getNumPartitions() == tasks


def test_features_exchange_rows_once(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = plan(queries.w13_turns_and_runs(spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert f"l_suppkey#" in found and f", {-(-rows // 100)})" in found
    assert "SortMergeJoin" not in found and found.count("Exchange hashpartitioning(l_suppkey") == 1


def test_a_folder_has_one_file(spark, tmp_path):
    rows = spark.range(0, 800, 1, 8).select((F.col("id") % 5).alias("recording_id"), "id")
    files.write_stage(rows, str(tmp_path), "rows")
    files.write_version(rows, str(tmp_path), "more", "a")
    for stage in ("rows", "more/run=a"):
        assert len(list(Path(tmp_path, stage).glob("recording_id=*/*.parquet"))) == 5
    assert sorted(r.id for r in files.read_version(spark, str(tmp_path), "more").collect()) == list(range(800))


def test_links_exchange_rows_once(spark):
    rows = spark.createDataFrame([(1, f, i, float(i), 0.0) for f in range(200) for i in range(3)], "recording_id long, frame long, det_id long, x double, y double")
    linked = linking.link_consecutive(rows)
    assert plan(linked).count("Exchange") == 1
    got = linked.collect()
    assert len(got) == 199 * 3 and all(r.det_id == r.next_id and r.distance == 0 for r in got)
    odd = spark.createDataFrame([(1, 0, 0, 1.0, 1.0), (1, 0, 1, None, 1.0), (1, 1, 0, float("nan"), 0.0), (1, 1, 1, 2.0, 1.0), (1, -1, 5, 1.0, 1.0)], rows.schema)
    assert {(r.frame, r.det_id, r.next_id, r.distance) for r in linking.link_consecutive(odd).collect()} == {(-1, 5, 0, 0.0), (0, 0, 1, 1.0)}


@pytest.mark.parametrize("pairs", [40, 1 << 20])
def test_nearest_against_all_pairs(monkeypatch, pairs):
    monkeypatch.setattr(linking, "PAIRS", pairs)
    r = np.random.default_rng(1)
    for t in range(120):
        a, b = (r.integers(0, 12, (k, 2)).astype(float) if t % 2 else r.normal(0, 5, (k, 2)) ** 3 for k in r.integers(1, 50, 2))
        a *= 50 if t % 7 == 0 else 1
        b[:, 1] = 3.0 if t % 11 == 0 else b[:, 1]
        far = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
        distance, at = linking.nearest(a, b)
        assert (at == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()


def test_marked_boxes_exchange_rows_once(spark):
    rows = [(1, f, k, 10.0 * k, 5.0, 4.0, 2.0, 0.0) for f in range(3) for k in range(4)] + [(1, 5, 0, float("inf"), 0.0, 4.0, 2.0, 0.0), (1, 5, 1, 1e17, 0.0, 4.0, 2.0, 0.0), (1, 5, 2, 0.0, 0.0, float("inf"), 2.0, 90.0)]
    boxes = spark.createDataFrame(rows, "recording_id long, frame long, det_id long, x double, y double, width double, height double, degrees_angle double")
    found = linking.link_marked(boxes, boxes.where("frame <> 1 and det_id < 2"))
    assert plan(found).count("Exchange") == 1
    assert sorted((r.frame, r.det_id) for r in found.collect()) == [(0, 0), (0, 1), (2, 0), (2, 1), (5, 1)]
    # The detections come by frame already: only those of the tracks are exchanged, for boxes and for markers.
    found = plan(queries.j6_keep_marked(spark, SF))
    assert found.count("Exchange hashpartitioning") == 4 and "Join" not in found


def brute(b, m):
    below = lambda v, limit: (np.abs(v) <= limit[:, None]) | np.isnan(limit)[:, None]
    with np.errstate(all="ignore"):
        dx, dy = m["x"] - b["x"][:, None], m["y"] - b["y"][:, None]
        cos, sin = b["cos"][:, None], b["sin"][:, None]
        return ((b["number"][:, None] == m["number"]) & below(dx * cos + dy * sin, b["half_width"]) & below(dy * cos - dx * sin, b["half_height"])).any(axis=1)


@pytest.mark.parametrize("pairs", [40, 1 << 20])
def test_marks_against_all_pairs(monkeypatch, pairs):
    monkeypatch.setattr(linking, "PAIRS", pairs)
    r = np.random.default_rng(2)
    names = ("recording_id", "frame", "marker", "x", "y", "half_width", "half_height", "cos", "sin")
    hits = 0
    for t in range(150):
        n, k = r.integers(1, 60, 2)
        far = (0.0, 0.0, 1e3, -1e9, 1e16, 1e300)[t % 6]
        b = {"number": np.sort(r.integers(0, 3, n)), "x": r.integers(0, 40, n) + far, "y": r.normal(0, 20, n) + far / 3}
        b |= {c: r.choice([0.0, 0.25, 1.0, 4.0, 30.0, 500.0], n) for c in ("half_width", "half_height")}
        angle = np.radians(r.choice([0.0, 90.0, 45.0, 13.7, -120.0], n))
        b |= {"cos": np.cos(angle), "sin": np.sin(angle)}
        m = {"number": np.sort(r.integers(0, 3, k)), "x": r.integers(0, 40, k) + far, "y": r.normal(0, 20, k) + far / 3}
        same = r.integers(0, n, k)
        m["x"], m["y"] = np.where(r.random(k) < 0.2, b["x"][same], m["x"]), np.where(r.random(k) < 0.2, b["y"][same], m["y"])
        if t % 5 == 0:
            for v in (b["x"], b["y"], b["half_width"], b["half_height"], b["cos"], m["x"], m["y"]):
                v[r.integers(0, len(v))] = r.choice([np.nan, np.inf, -np.inf])
        want = brute(b, m)
        assert (linking.holding(b, m) == want).all()
        # Rows by frame, markers first, in batches that end anywhere.
        rows = [(1, f, True, m["x"][i], m["y"][i], *[None] * 4, None) for f in range(3) for i in np.flatnonzero(m["number"] == f)]
        rows += [(1, f, False, *(b[c][i] for c in names[3:]), {"i": int(i)}) for f in range(3) for i in np.flatnonzero(b["number"] == f)]
        rows.sort(key=lambda v: (v[1], not v[2]))
        schema = pa.schema([("recording_id", pa.int64()), ("frame", pa.int64()), ("marker", pa.bool_()), *((c, pa.float64()) for c in names[3:]), ("row", pa.struct([("i", pa.int64())]))])
        whole = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        size = int(r.integers(1, 20))
        got = [i for part in linking._keep(whole.slice(a, size) for a in range(0, len(rows), size)) for i in part.column("i").to_pylist()]
        assert sorted(got) == np.flatnonzero(want).tolist()
        hits += len(got)
    assert hits > 500


class State:
    """A state of one recording that counts what is stored."""

    def __init__(self):
        self.held, self.stored = {}, 0

    def exists(self):
        return bool(self.held)

    def get(self):
        return self.held[()]

    def update(self, value):
        self.updateValue((), value)

    def clear(self):
        self.held = {}

    def keys(self):
        return list(self.held)

    def containsKey(self, key):
        return key in self.held

    def getValue(self, key):
        return self.held[key]

    def updateValue(self, key, value):
        self.held[key] = value
        self.stored += 1

    def removeKey(self, key):
        del self.held[key]


class Handle:
    def __init__(self):
        self.states = {}

    def getValueState(self, name, schema):
        return self.states.setdefault(name, State())

    def getMapState(self, name, key, value):
        return self.getValueState(name, value)

    def listTimers(self):
        return []

    def registerTimer(self, at):
        pass


class Mark:
    def getCurrentWatermarkInMs(self):
        return 0


def test_frames_that_come_with_the_end_are_not_stored():
    rows = pd.DataFrame({"fps": 30.0, "frame": np.repeat(np.arange(20), 2), "det_id": [2.0, 1.0] * 20, "x": [5.0, 1.0] * 20, "y": 1.0, "width": 1.0, "height": 2.0, "degrees_angle": 0.0})
    end = pd.DataFrame({"fps": [30.0], "frame": [25], "det_id": [np.nan], "x": [np.nan], "y": [np.nan], "width": [np.nan], "height": [np.nan], "degrees_angle": [np.nan]})

    def run(parts):
        t, handle, out = jobs.StreamingTracker(None, 10.0), Handle(), []
        t.init(handle)
        for batch in parts:
            out += list(t.handleInputRows((7,), iter(batch), Mark()))
        return pd.concat(out).astype(float).reset_index(drop=True), handle.states["waiting"]

    at_once, state = run([[rows, end]])
    assert state.stored == 0
    apart, state = run([[rows[:21]], [rows[21:], end]])
    assert state.stored > 0 and not state.held
    pd.testing.assert_frame_equal(at_once, apart)
    assert len(at_once) == 50 and at_once[at_once.position_t == 3].position_x.tolist() == [1.0, 5.0]
