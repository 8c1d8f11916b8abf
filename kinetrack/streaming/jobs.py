"""Structured Streaming forms of the tracker, the fragments and the per-second sums."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.tracking import new_tracker, rows_of
from ..schemas import TRACKS
from ..settings import Settings

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Event time of frame 0 in milliseconds: a first frame at the initial watermark, 0, would count as late.
START_MS = 1000
_NAMES = [c.split()[0] for c in TRACKS.split(", ")]


def _stretches(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first place, place after the last) of each stretch of equal values."""
    if len(sorted_values):
        begins = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])).tolist()
        yield from ((int(sorted_values[i]), i, j) for i, j in zip(begins, [*begins[1:], len(sorted_values)], strict=True))


def _by_id(held: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A frame's values in the order of ``det_id``, then of the values."""
    ids, values = (np.concatenate(c) for c in zip(*held, strict=True))
    return values[np.lexsort((*values.T[::-1], ids))]


class StreamingTracker(StatefulProcessor):
    """The batch tracker's state machine per recording; frames wait in state until the watermark has passed them.

    A row without ``det_id`` says that the recording has ended and how many frames it has: what waits, and what comes
    with it, which is not stored first, is walked at once, up to that frame, and all state goes. Without such a row a recording that has no detections for ``idle``
    seconds of event time is over; only its next id is kept, so that ids never repeat should it go on.
    """

    def __init__(self, settings: Settings | None, idle: float):
        self.settings, self.idle = settings, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rate = handle.getValueState("rate", "fps double")
        self.saved = handle.getValueState("tracker", "tracker binary, frame long")
        self.waiting = handle.getMapState("waiting", "frame long", "rows binary")
        self.next_id = handle.getValueState("next_id", "id long")

    def _advance(self, recording: int, upto: int, end: bool = False, fresh: dict[int, list] | None = None) -> Iterator[pd.DataFrame]:
        """Walk the waiting frames before ``upto``; at the recording's ``end`` also those after the last that waits.

        ``fresh`` has detections that have just come and are walked without being stored.
        """
        fresh = fresh or {}
        state = self.saved.get() if self.saved.exists() else None
        tracker, frame = (pickle.loads(state[0]), state[1]) if state else (new_tracker(self.rate.get()[0], self.settings), None)
        if not state and self.next_id.exists():
            tracker.next_id = self.next_id.get()[0]
        stored = {k[0] for k in self.waiting.keys()}
        ready = sorted(f for f in stored | fresh.keys() if f < upto)
        rows = []
        for f in ready:
            while frame is not None and frame < f:
                rows.append(rows_of(recording, frame, tracker.step(np.zeros((0, 2)), np.zeros((0, 3)))))
                frame += 1
            held = fresh.get(f, [])
            if f in stored:
                held = pickle.loads(self.waiting.getValue((f,))[0]) + held
                self.waiting.removeKey((f,))
            d = _by_id(held)
            rows.append(rows_of(recording, f, tracker.step(d[:, :2], d[:, 2:])))
            frame = f + 1
        while end and frame is not None and frame < upto and len(tracker.ids):
            rows.append(rows_of(recording, frame, tracker.step(np.zeros((0, 2)), np.zeros((0, 3)))))
            frame += 1
        if ready and not end:
            self.saved.update((pickle.dumps(tracker), frame))
        if rows:
            yield pd.DataFrame({n: np.concatenate(c) for n, c in zip(_NAMES, zip(*rows, strict=True), strict=True)})

    def _wait(self, mark: int) -> None:
        """Set the timer for the first waiting frame, or for the end of the recording, which may have come."""
        fps = self.rate.get()[0]
        first = min((k[0] for k in self.waiting.keys()), default=None)
        if first is not None:
            self.handle.registerTimer(int((first + 1) * 1000 / fps) + 1 + START_MS)
            return
        over = int((self.saved.get()[1] / fps + self.idle) * 1000) + START_MS
        if over > mark:
            self.handle.registerTimer(over)
        else:
            self.next_id.update((pickle.loads(self.saved.get()[0]).next_id,))
            for state in (self.rate, self.saved):
                state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        end, fresh = None, {}
        for part in rows:
            if len(part) and not self.rate.exists():
                self.rate.update((float(part["fps"].iloc[0]),))
            marks = part[part["det_id"].isna()]
            if len(marks):
                end, part = int(marks["frame"].max()), part[part["det_id"].notna()]
            order = np.argsort(part["frame"].to_numpy(), kind="stable")
            frames, ids = part["frame"].to_numpy()[order], part["det_id"].to_numpy().astype(np.int64)[order]
            values = part[["x", "y", "width", "height", "degrees_angle"]].to_numpy(float)[order]
            for f, i, j in _stretches(frames):
                fresh.setdefault(f, []).append((ids[i:j], values[i:j]))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if end is not None:
            last = max([*(k[0] for k in self.waiting.keys()), *fresh], default=-1)
            yield from self._advance(key[0], max(end, last + 1), end=True, fresh=fresh)
            for state in (self.rate, self.saved, self.next_id):
                state.clear()
            return
        for f, held in fresh.items():
            if self.waiting.containsKey((f,)):
                held = pickle.loads(self.waiting.getValue((f,))[0]) + held
            self.waiting.updateValue((f,), (pickle.dumps(held),))
        self._wait(timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({n: [] for n in _NAMES})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        yield from self._advance(key[0], int((mark - START_MS) * self.rate.get()[0] / 1000))
        self._wait(mark)

    def close(self) -> None:
        pass


def track_stream(detections: DataFrame, fps: float | None = None, settings: Settings | None = None, delay: str = "1 second", idle: float = 3600.0) -> DataFrame:
    """Track a stream of detections. Event time is frame / fps seconds, a second later; needs the RocksDB state store.

    Without ``fps`` each recording has the rate in its rows' column ``fps`` (NULL or not above 0: the settings' default).
    A row without ``det_id`` ends its recording: ``frame`` is then the number of frames, and what comes later is of a new
    one. Without an end, the frames of the last ``delay`` stay in state. ``idle`` must be longer than any pause inside a
    recording: objects after it are new ones.
    """
    rate = F.lit(float(fps)) if fps else F.when(F.col("fps") > 0, F.col("fps")).otherwise(F.lit((settings or Settings()).fps)).cast("double")
    timed = detections.withColumn("fps", rate)
    timed = timed.withColumn("ts", F.timestamp_millis((F.col("frame") * 1000 / F.col("fps")).cast("long") + START_MS)).withWatermark("ts", delay)
    schema = TRACKS.replace("BIGINT", "long")
    return timed.groupBy("recording_id").transformWithStateInPandas(StreamingTracker(settings, idle), schema, "append", "EventTime")


def write_stream(df: DataFrame, path: str, checkpoint: str):
    """Append results to a table as they come, until the input that is there now is done."""
    return df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()


def write_batches(df: DataFrame, path: str, checkpoint: str):
    """Write each batch of a stream to a folder of its own, which a replay of the batch replaces: no row comes twice."""
    return df.writeStream.foreachBatch(batch_writer(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_writer(path: str):
    """What ``write_batches`` does with a batch. Read the folder as a table; ``batch`` is its partition column."""

    def write(part: DataFrame, number: int) -> None:
        part.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return write


def speed_per_second(rows: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Path of each track in tumbling seconds of event time ``ts``."""
    out = rows.withWatermark("ts", delay).groupBy("recording_id", "track_id", F.window("ts", "1 second").alias("w"))
    return out.agg(F.sum("step").alias("path"), F.count("*").alias("n")).select("recording_id", "track_id", F.col("w.start").alias("second"), "path", "n")


def hole_gap(s: Settings, fps: str | Column = "fps") -> Column:
    """The gap that closes a fragment: half a frame more than the largest hole, at each row's rate."""
    seconds = (s.max_holes + 0.5) / (F.col(fps) if isinstance(fps, str) else fps)
    return F.concat(F.round(seconds * 1e6).cast("long").cast("string"), F.lit(" microseconds"))


def fragments_stream(rows: DataFrame, gap: str | Column, delay: str = "10 seconds") -> DataFrame:
    """Session form of the hole rule: a larger gap than ``gap`` closes a fragment. A column gives each row its own."""
    out = rows.withWatermark("ts", delay).groupBy("recording_id", "track_id", F.session_window("ts", gap).alias("w"))
    return out.agg(F.count("*").alias("n_rows"), F.min("ts").alias("start_ts"), F.max("ts").alias("stop_ts")).select("recording_id", "track_id", "n_rows", "start_ts", "stop_ts")


def threshold_stream(stats: DataFrame, offset: float, length: str = "5 seconds", slide: str = "1 second", delay: str = "10 seconds", dark: bool = False) -> DataFrame:
    """Sliding mean of the grey threshold over event time, truncated; of dark cells the deviation is taken off.

    Thresholds are summed in whole millionths: a sum of doubles depends on the order of the rows, and with it whether a
    mean that is a whole number is cut to the one below.
    """
    deviation = -F.col("grey_std") if dark else F.col("grey_std")
    one = (F.col("grey_mean") + deviation + offset).cast("decimal(28,6)")
    out = stats.withWatermark("ts", delay).groupBy("recording_id", F.window("ts", length, slide).alias("w"))
    whole = F.expr("cast(total div n as int)").alias("threshold")
    return out.agg(F.sum(one).alias("total"), F.count(one).alias("n")).select("recording_id", F.col("w.end").alias("at"), F.when(F.col("n") > 0, whole).alias("threshold"))


def dedupe_stream(detections: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Drop repeated detections that arrive within the watermark."""
    return detections.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["recording_id", "frame", "det_id"])
