"""The tracker: a state walked over the frames of each recording, vectorised over the objects of a frame."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import KEY, TRACKS
from ..settings import Settings

LEAST_LIKELIHOOD = 1e-20


def horizons(filters: int, low: int, high: int) -> list[int]:
    return [int(low + (high - low) / filters * i) for i in range(1, filters + 1)]


def line_weights(n: int) -> np.ndarray:
    """Weights of the last n positions, oldest first, in the least-squares prediction of the next."""
    if n < 2:
        raise ValueError("a line needs two positions")
    k = np.arange(n)
    return 2 * (3 * k - n + 1) / (n * (n - 1))


class FilterBank:
    """Gaussian-sum FIR filters of several horizons for many objects at once."""

    def __init__(self, lengths: list[int]):
        self.n, self.lines = lengths, [line_weights(n) for n in lengths]
        self.keep = lengths[-1] + 1
        self.history = np.zeros((0, self.keep, 2))
        self.count = np.zeros(0, np.int64)
        self.mode = np.zeros(0, np.int64)
        self.weight = np.zeros((0, len(lengths)))
        self.guess = np.zeros((0, len(lengths), 2))

    def add(self, k: int) -> None:
        self.history = np.concatenate([self.history, np.zeros((k, self.keep, 2))])
        self.count, self.mode = (np.concatenate([v, np.zeros(k, np.int64)]) for v in (self.count, self.mode))
        self.weight = np.concatenate([self.weight, np.zeros((k, len(self.n)))])
        self.guess = np.concatenate([self.guess, np.zeros((k, len(self.n), 2))])

    def keep_only(self, alive: np.ndarray) -> None:
        for name in ("history", "count", "mode", "weight", "guess"):
            setattr(self, name, getattr(self, name)[alive])

    def _predictions(self) -> None:
        for i, (n, line) in enumerate(zip(self.n, self.lines, strict=True)):
            own = self.mode > i
            if own.any():
                self.guess[own, i] = np.einsum("k,okd->od", line, self.history[own, -n:])

    def correct(self, at: np.ndarray) -> np.ndarray:
        new = self.count == 0
        if new.any():
            self.history[new] = at[new, None, :]
            self.count[new] = self.n[0]
        before = self.mode.copy()
        for i, n in enumerate(self.n):
            self.mode = np.where((self.mode == i) & (self.count >= n), i + 1, self.mode)
        changed = self.mode != before
        if changed.any():
            kept = self.guess.copy()
            self._predictions()
            self.guess[~changed] = kept[~changed]
            slots = np.arange(len(self.n))[None, :] < self.mode[:, None]
            self.weight[changed] = (slots / np.maximum(self.mode, 1)[:, None])[changed]
        error = ((at[:, None, :] - self.guess) ** 2).sum(axis=2)
        likely = np.maximum(np.exp(-0.5 * error), LEAST_LIKELIHOOD) * self.weight
        total = likely.sum(axis=1, keepdims=True)
        self.weight = np.divide(likely, total, out=np.zeros_like(likely), where=total > 0)
        self.history = np.concatenate([self.history[:, 1:], at[:, None, :]], axis=1)
        self.count = np.minimum(self.count + 1, self.keep)
        return (self.weight[:, :, None] * self.guess).sum(axis=1)

    def predict(self) -> np.ndarray:
        self._predictions()
        return (self.weight[:, :, None] * self.guess).sum(axis=1)


@dataclass
class Tracker:
    """Objects of one recording. ``step`` takes a frame's detections and returns the rows of all living objects."""

    max_missed: int
    bank: FilterBank | None = None
    next_id: int = 0
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    at: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    extra: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))
    missed: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: Whether to look for two objects that are equally near to one detection, and whether there were any.
    watch: bool = False
    tied: bool = False

    def _look_for_ties(self, want: np.ndarray, distance: np.ndarray) -> None:
        by = np.lexsort((distance, want))
        w, d = want[by], distance[by]
        nearest = np.append(True, w[1:] != w[:-1])[:-1]
        self.tied |= bool((nearest & (w[1:] == w[:-1]) & (d[1:] == d[:-1])).any())

    def _register(self, at: np.ndarray, extra: np.ndarray) -> None:
        k = len(at)
        self.ids = np.concatenate([self.ids, np.arange(self.next_id, self.next_id + k)])
        self.at, self.extra = np.concatenate([self.at, at]), np.concatenate([self.extra, extra])
        self.missed = np.concatenate([self.missed, np.zeros(k, np.int64)])
        self.next_id += k
        if self.bank:
            self.bank.add(k)

    def _miss(self, lost: np.ndarray) -> None:
        self.missed[lost] += 1
        self.extra[lost] = 0
        alive = self.missed <= self.max_missed
        if not alive.all():
            self.ids, self.at, self.extra, self.missed = self.ids[alive], self.at[alive], self.extra[alive], self.missed[alive]
            if self.bank:
                self.bank.keep_only(alive)

    def step(self, at: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(at):
            self._miss(np.ones(len(self.ids), bool))
        elif not len(self.ids):
            self._register(at, extra)
        else:
            far = np.sqrt(((self.at[:, None, :] - at[None, :, :]) ** 2).sum(axis=2))
            want, distance = far.argmin(axis=1), far.min(axis=1)
            if self.watch:
                self._look_for_ties(want, distance)
            # Of the objects that want a detection the closest has it; ties go to the one registered first.
            order = np.lexsort((np.arange(len(want)), distance))
            taken, first = np.unique(want[order], return_index=True)
            winner = order[first]
            more = len(at) > len(self.ids)
            self.at[winner], self.extra[winner], self.missed[winner] = at[taken], extra[taken], 0
            if more:
                free = np.setdiff1d(np.arange(len(at)), taken)
                self._register(at[free], extra[free])
            else:
                lost = np.ones(len(self.ids), bool)
                lost[winner] = False
                self._miss(lost)
        out = self.at
        if self.bank and len(self.ids):
            out = self.bank.correct(self.at)
            self.at = self.bank.predict()
        return self.ids, out, self.extra


def new_tracker(fps: float, s: Settings | None, dims: int = 2) -> Tracker:
    """A tracker for one recording; with settings the filters are on. ``dims`` 3: brightness is a coordinate too."""
    bank = None
    if s is not None:
        bank = FilterBank(horizons(s.filters, s.min_horizon, int(round(fps)) if s.max_horizon is None else s.max_horizon))
    return Tracker(int(round(fps)), bank, at=np.zeros((0, dims)))


_NAMES = [c.split()[0] for c in TRACKS.split(", ")]


def rows_of(recording: int, frame: int, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple:
    ids, at, extra = found
    n = len(ids)
    return (np.full(n, recording), ids.copy(), np.full(n, frame), at[:, 0].copy(), at[:, 1].copy(), extra[:, 0].copy(), extra[:, 1].copy(), extra[:, 2].copy(), *at[:, 2:].T.copy())


def _track(s: Settings | None, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tracker, recording, frame, end = None, None, 0, None
        held: list = []
        out: list[tuple] = []

        def walk_to(stop: int) -> None:
            """Visit the frames before ``stop``; only the one that is held has detections."""
            nonlocal frame, held
            while tracker is not None and frame < stop:
                d = np.concatenate([np.zeros((0, dims + 3)), *held])
                out.append(rows_of(recording, frame, tracker.step(d[:, :dims], d[:, dims:])))
                held, frame = [], frame + 1
                if not len(tracker.ids) and stop - frame > 1:
                    frame = stop if stop != float("inf") else frame  # nothing lives: empty frames have no rows

        def drained(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal out
            if sum(len(r[0]) for r in out) >= least and out:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=[*_NAMES, "illumination"][: len(out[0])])
                out = []

        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ["x", "y", "illumination"][:dims] + ["width", "height", "degrees_angle"]], axis=1)
            key = np.stack([batch.column(c).fill_null(-1).to_numpy() for c in ("recording_id", "frame")])
            begins = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
            # One turn for each frame that has detections; a frame may go on in the next batch.
            for i, j in zip(begins.tolist(), [*begins[1:].tolist(), batch.num_rows], strict=True):
                r, f, fps, count = (batch.column(c)[i].as_py() for c in ("recording_id", "frame", "fps", "frame_count"))
                if r != recording or tracker is None:
                    walk_to(max(frame + 1, end or 0) if tracker is not None else 0)
                    tracker, recording, frame, end, held = new_tracker(fps, s, dims), r, f, count, []
                if f > frame:
                    walk_to(f)
                    yield from drained(50_000)
                held.append(values[i:j])
        walk_to(max(frame + 1, end or 0) if tracker is not None else 0)
        yield from drained(1)

    return run


def track(detections: DataFrame, s: Settings | None = None, luminosity: bool = False) -> DataFrame:
    """Link detections over the frames of each recording into tracks; with ``s`` positions are filtered.

    With ``luminosity`` the column ``illumination`` (NULL: 0) is a third coordinate of the distance and of the result;
    the filters work in two, so both together are refused.

    ``detections`` has ``fps`` and ``frame_count`` (NULL: the walk ends at the last detection). Recordings
    are walked in parallel, each in order of frames with the state of one frame in memory.
    """
    if luminosity and s is not None:
        raise ValueError("filtered positions have two coordinates: track by luminosity without settings")
    more = [F.coalesce(F.col("illumination").cast("double"), F.lit(0.0)).alias("illumination")] if luminosity else []
    wanted = detections.select("recording_id", "frame", "det_id", "x", "y", "width", "height", "degrees_angle", F.col("fps").cast("double").alias("fps"), F.col("frame_count").cast("long").alias("frame_count"), *more)
    ordered = wanted.repartition("recording_id").sortWithinPartitions("recording_id", "frame", "det_id")
    schema = TRACKS.replace("BIGINT", "long") + (", illumination double" if luminosity else "")
    return ordered.mapInArrow(_track(s, 2 + luminosity), schema)


#: Rows of whole tracks that are filtered together.
TOGETHER = 200_000


def filter_together(at: np.ndarray, first: np.ndarray, lengths: list[int]) -> np.ndarray:
    """Filtered positions of several tracks' rows; all tracks take a step at once, the longest first.

    ``first`` has the first row of each track and the end.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    out, bank = np.empty_like(at), FilterBank(lengths)
    bank.add(len(order))
    alive = len(order)
    for t in range(int(size[0]) if len(size) else 0):
        going = int(np.searchsorted(-size, -t, "left"))  # tracks with more than t rows
        if going < alive:
            bank.keep_only(np.arange(alive) < going)
            alive = going
        rows = begin[:alive] + t
        out[rows] = bank.correct(at[rows])
        bank.predict()
    return out


def _filter(lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        enough = TOGETHER

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, enough
            table = pa.Table.from_batches(held).combine_chunks()
            key = np.stack([table.column(c).fill_null(-1).to_numpy() for c in KEY])
            first = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [table.num_rows]])
            if not last:  # the last track may go on
                first = first[:-1]
            held = table.slice(int(first[-1])).to_batches()
            ready = table.slice(0, int(first[-1]))
            enough = max(TOGETHER, 2 * (table.num_rows - ready.num_rows))  # a long track is not put together again with each batch
            if ready.num_rows:
                at = filter_together(np.stack([ready.column(c).to_numpy() for c in ("position_x", "position_y")], axis=1), first, lengths)
                ready = ready.append_column("filtered_x", pa.array(at[:, 0])).append_column("filtered_y", pa.array(at[:, 1]))
                yield from ready.to_batches(max_chunksize=10_000)

        for batch in batches:
            held += [batch] if batch.num_rows else []
            if sum(b.num_rows for b in held) >= enough:
                yield from done(False)
        if held:
            yield from done(True)

    return run


def gsff(tracks: DataFrame, s: Settings, fps: float | None = None) -> DataFrame:
    """Filter finished tracks: each row's corrected position in ``filtered_x`` and ``filtered_y``.

    The tracks of a partition are filtered together, row by row; a task holds about ``TOGETHER`` rows, or one track.
    """
    lengths = horizons(s.filters, s.min_horizon, int(round(fps or s.fps)) if s.max_horizon is None else s.max_horizon)
    ordered = tracks.select(*KEY, "position_t", "position_x", "position_y").repartition(*KEY).sortWithinPartitions(*KEY, "position_t")
    return ordered.mapInArrow(_filter(lengths), "recording_id long, track_id long, position_t long, position_x double, position_y double, filtered_x double, filtered_y double")
