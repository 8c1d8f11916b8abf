"""The tracker over time slices of recordings: slices are walked in parallel and their objects are joined up.

A slice begins its walk some frames early, without any objects. Once as many frames have passed as an object may be
missed, its objects are mostly those of the slice before: where both have the same places and counts of missed
frames at the border, all that follows is the same, so only names are to be joined. A slice whose objects differ
there, or in which two objects were equally near to one detection (the older one has it, and a slice does not know
which is older), is walked again from the objects that the slice before ended with, until all agree.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import TRACKS
from ..sources.tables import written
from .tracking import Tracker, rows_of

_NAMES = [c.split()[0] for c in TRACKS.split(", ")]
_STATE = "state_of binary, entry binary, exit binary, first_id long, births long, tied boolean"


def _snapshot(t: Tracker) -> bytes:
    return pickle.dumps((t.ids, t.at, t.missed))


class _Slice:
    """The walk over one slice."""

    def __init__(self, row: dict, dims: int):
        self.recording, self.slice, self.begin, self.end = row["recording_id"], row["slice"], row["begin"], row["end"]
        self.tracker = Tracker(row["max_missed"], at=np.zeros((0, dims)))
        self.dims, self.given, self.entry, self.first_id = dims, row["state"], None, 0
        self.frame, self.held, self.out = row["frame"], [], []
        if self.given is not None:
            at, missed = pickle.loads(self.given)
            t, n = self.tracker, len(at)
            t.ids, t.at, t.missed, t.extra, t.next_id = np.arange(n), at, missed, np.zeros((n, 3)), n
            self.frame = self.begin

    def _enter(self) -> None:
        if self.entry is None and self.frame >= self.begin:
            self.entry, self.first_id = _snapshot(self.tracker), self.tracker.next_id
            self.tracker.watch, self.tracker.tied = True, False

    def walk_to(self, stop: int) -> None:
        """Visit the frames before ``stop``; only the one that is held has detections."""
        stop = min(stop, self.end)
        while self.frame < stop:
            self._enter()
            d = np.concatenate([np.zeros((0, self.dims + 3)), *self.held])
            found = self.tracker.step(d[:, : self.dims], d[:, self.dims :])
            if self.entry is not None:
                self.out.append(rows_of(self.recording, self.frame, found))
            self.held, self.frame = [], self.frame + 1
            if not len(self.tracker.ids):  # nothing lives: empty frames have no rows
                self.frame = max(self.frame, min(stop, self.begin) if self.entry is None else stop)

    def finish(self) -> dict:
        self.walk_to(self.end)
        self.frame = max(self.frame, self.begin)
        self._enter()
        t = self.tracker
        return {"state_of": self.given, "entry": self.entry, "exit": _snapshot(t), "first_id": self.first_id, "births": t.next_id - self.first_id, "tied": t.tied}


def _walk(dims: int):
    names = [*_NAMES, "illumination"][: len(_NAMES) + dims - 2]

    def rows(s: _Slice) -> Iterator[pa.RecordBatch]:
        if s.out:
            columns = [pa.array(np.concatenate(c)) for c in zip(*s.out, strict=True)]
            n = len(columns[0])
            blank = [pa.nulls(n, t) for t in (pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_())]
            yield pa.record_batch([pa.array(np.full(n, s.slice)), *columns, *blank], names=["slice", *names, *(c.split()[0] for c in _STATE.split(", "))])
            s.out = []

    def ended(s: _Slice) -> Iterator[pa.RecordBatch]:
        state = s.finish()
        yield from rows(s)
        kinds = [pa.int64() if c in _NAMES[:3] else pa.float64() for c in names]
        first = [pa.array([s.recording if c == "recording_id" else None], t) for c, t in zip(names, kinds, strict=True)]
        last = [pa.array([v], t) for v, t in zip(state.values(), (pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()), strict=True)]
        yield pa.record_batch([pa.array([s.slice], pa.int64()), *first, *last], names=["slice", *names, *state])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ["x", "y", "illumination"][:dims] + ["width", "height", "degrees_angle"]], axis=1)
            key = np.stack([batch.column(c).fill_null(-1).to_numpy() for c in ("recording_id", "slice", "frame")])
            begins = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
            for i, j in zip(begins.tolist(), [*begins[1:].tolist(), batch.num_rows], strict=True):
                row = batch.slice(i, 1).to_pylist()[0]
                if now is None or (row["recording_id"], row["slice"]) != (now.recording, now.slice):
                    if now is not None:
                        yield from ended(now)
                    now = _Slice(row, dims)
                    if now.given is not None:  # a row that only carries the objects to begin with
                        i += 1
                if i < j:
                    now.walk_to(row["frame"])
                    now.held.append(values[i:j])
                    if len(now.out) > 500:
                        yield from rows(now)
        if now is not None:
            yield from ended(now)

    return run


def _agreed(was: tuple, row: dict) -> np.ndarray | None:
    """Which object at the end of the slice before each object at the border is; None if the slice must be walked again.

    ``was`` has the places and missed frames that the slice before ended with, oldest object first.
    """
    at, missed = was
    if row["state_of"] is not None:
        given = pickle.loads(row["state_of"])
        return np.arange(len(at)) if np.array_equal(given[0], at) and np.array_equal(given[1], missed) else None
    _, own, gone = pickle.loads(row["entry"])
    names = lambda a, m: [x.tobytes() for x in np.column_stack([a, m])]
    left, right = names(at, missed), names(own, gone)
    if row["tied"] or len(set(left)) < len(left) or sorted(left) != sorted(right):
        return None
    spot = {x: k for k, x in enumerate(left)}
    return np.array([spot[x] for x in right], np.int64)


def _stitch(table: pa.Table) -> pa.Table:
    """What each slice's objects are called in the whole recording, or the objects from which it is to be walked again."""
    out, dims = [], None
    before, ids = None, np.zeros(0, np.int64)  # the objects that the slice before ended with, by age
    born = 0
    for row in sorted(table.to_pylist(), key=lambda r: r["slice"]):
        local, at, missed = pickle.loads(row["exit"])
        dims = at.shape[1]
        if before is None or before[0] != row["slice"] - 1:
            before, ids = (row["slice"] - 1, np.zeros((0, dims)), np.zeros(0, np.int64)), np.zeros(0, np.int64)
        same = _agreed(before[1:], row)
        entered = pickle.loads(row["entry"])[0]
        known = ids[same] if same is not None else np.full(len(entered), -1)
        name = dict(zip(entered.tolist(), known.tolist(), strict=True))
        out.append({"recording_id": row["recording_id"], "slice": row["slice"], "round": row["round"], "restart": pickle.dumps(before[1:]) if same is None else None, "shift": born - row["first_id"], "carried": [{"local": a, "whole": b} for a, b in name.items()]})
        whole = np.array([name.get(i, i - row["first_id"] + born) for i in local.tolist()], np.int64)
        order = np.argsort(whole, kind="stable")
        before, ids = (row["slice"], at[order], missed[order]), whole[order]
        born += row["births"]
    return pa.Table.from_pylist(out, pa.schema({"recording_id": pa.int64(), "slice": pa.int64(), "round": pa.int32(), "restart": pa.binary(), "shift": pa.int64(), "carried": pa.list_(pa.struct({"local": pa.int64(), "whole": pa.int64()}))}))


def track_in_slices(detections: DataFrame, slice_frames: int = 2000, luminosity: bool = False) -> DataFrame:
    """``tracking.track`` without filters, with one task for each slice of ``slice_frames`` frames of a recording.

    The rows are those of the walk over whole recordings, with the same ids. The filters' weights depend on all frames
    before, so filtered recordings are walked as a whole. A slice has at least as many frames as its early begin: two
    seconds and one frame. Of a recording only the objects at the slices' borders meet in one task.
    """
    dims = 2 + luminosity
    extra = [F.coalesce(F.col("illumination").cast("double"), F.lit(0.0)).alias("illumination")] if luminosity else []
    rows = detections.select("recording_id", "frame", "det_id", "x", "y", *extra, "width", "height", "degrees_angle")
    ends = detections.groupBy("recording_id").agg(F.max("fps").cast("double").alias("fps"), F.greatest(F.max("frame") + 1, F.max("frame_count").cast("long")).alias("stop"))
    missed = F.bround("fps").cast("long")
    ends = ends.select("recording_id", "stop", missed.alias("max_missed"), (2 * missed + 1).alias("early")).withColumn("length", F.greatest(F.lit(slice_frames).cast("long"), "early"))
    own = F.floor(F.col("frame") / F.col("length"))
    next_ = F.when((F.col("frame") >= (own + 1) * F.col("length") - F.col("early")) & ((own + 1) * F.col("length") < F.col("stop")), own + 1)
    cut = rows.join(ends, "recording_id").withColumn("slice", F.explode(F.array_compact(F.array(own, next_))))
    cut = cut.withColumns({"begin": F.col("slice") * F.col("length"), "end": F.least((F.col("slice") + 1) * F.col("length"), "stop"), "state": F.lit(None).cast("binary")}).drop("early", "length", "stop")
    cut = written(cut)  # every round reads it
    schema = "slice long, " + TRACKS.replace("BIGINT", "long") + (", illumination double, " if luminosity else ", ") + _STATE

    def walk(part: DataFrame, number: int) -> DataFrame:
        ordered = part.repartition("recording_id", "slice").sortWithinPartitions("recording_id", "slice", "frame", F.col("state").isNull(), "det_id")
        return written(ordered.mapInArrow(_walk(dims), schema).withColumn("round", F.lit(number)))

    every, number = walk(cut, 0), 0
    names = "recording_id long, slice long, round int, restart binary, shift long, carried array<struct<local:long,whole:long>>"
    while True:
        states = every.where("exit is not null").select("recording_id", "slice", "round", *(c.split()[0] for c in _STATE.split(", ")))
        latest = states.groupBy("recording_id", "slice").agg(F.max_by(F.struct(*states.columns), "round").alias("s")).select("s.*")
        joined = written(latest.groupBy("recording_id").applyInArrow(_stitch, names))
        again = joined.where("restart is not null").select("recording_id", "slice", F.col("restart"))
        if again.isEmpty():
            break
        number += 1
        todo = cut.drop("state").join(again, ["recording_id", "slice"])
        heads = todo.groupBy("recording_id", "slice").agg(*[F.first(c).alias(c) for c in ("max_missed", "begin", "end", "restart")])
        heads = heads.select("*", F.col("begin").alias("frame"), F.col("restart").alias("state"))
        todo = todo.where("frame >= begin").drop("restart").unionByName(heads.drop("restart"), allowMissingColumns=True)
        every = every.unionByName(walk(todo, number))
    found = every.where("exit is null").join(joined.select("recording_id", "slice", "round", "shift"), ["recording_id", "slice", "round"])
    carried = joined.select("recording_id", "slice", F.inline("carried")).withColumnRenamed("local", "track_id")
    found = found.join(carried, ["recording_id", "slice", "track_id"], "left")
    columns = [*_NAMES, *(["illumination"] if luminosity else [])]
    return found.withColumn("track_id", F.coalesce("whole", F.col("track_id") + F.col("shift"))).select(*columns)
