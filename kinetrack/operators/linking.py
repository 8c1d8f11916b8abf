"""Joins between detections of frames, without memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Frames of a recording that one task links together; the first of each block also ends the block before.
BLOCK = 64
#: Pairs of detections whose distances are held at once; frames with more pairs are linked by grid cells.
PAIRS = 1 << 20


def _spread(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the range, place) of every place in the ranges ``first`` to ``last``, at most ``PAIRS`` at once."""
    size = last - first
    ends = np.cumsum(size)
    for k in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        i, j = np.searchsorted(ends, k, "right"), np.searchsorted(ends, min(k + PAIRS, ends[-1]), "left") + 1
        low, high = np.maximum(first[i:j], first[i:j] + k - (ends - size)[i:j]), np.minimum(last[i:j], last[i:j] + k + PAIRS - ends[i:j])
        n = high - low
        yield np.repeat(np.arange(i, j), n), np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)


def _among(a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray, order: np.ndarray, own: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
    """Note for each place ``a[own]`` the nearest of ``b[order[first:last]]`` where it beats ``best``; the least index on ties."""
    for of, other in _spread(first, last):
        of, other = own[of], order[other]
        d = b[other] - a[of]
        far = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1])
        by = np.lexsort((other, far, of))
        by = by[np.append(True, of[by][1:] != of[by][:-1])]
        of, far, other = of[by], far[by], other[by]
        better = (far < best[of]) | ((far == best[of]) & (other < at[of]))
        best[of[better]], at[of[better]] = far[better], other[better]


def nearest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of ``a`` the distance and index of the nearest of ``b``, the least index on ties.

    Many places meet those of the nine grid cells around them, of a side by their density that is doubled for those that
    have none within it, until all others are nearer by.
    """
    best, at = np.full(len(a), np.inf), np.full(len(a), len(b))
    rest, every = np.arange(len(a)), np.arange(len(b))
    low, span = b.min(axis=0), np.ptp(b, axis=0)
    side = float(np.sqrt(span[0] * span[1] / len(b)))
    while len(a) * len(b) > PAIRS and len(rest) and 0 < side < span.max():
        cell = np.floor((b - low) / side).astype(np.int64)
        width = int(cell[:, 1].max()) + 3
        code = cell[:, 0] * width + cell[:, 1] + 1
        order = np.argsort(code, kind="stable")
        code = code[order]
        # Places beyond the grid by more than a cell meet nothing here.
        spot = np.floor(np.clip((a[rest] - low) / side, -2, span.max() / side + 2)).astype(np.int64)
        spot[:, 1] = np.clip(spot[:, 1], -2, width)
        for dx in (-1, 0, 1):
            # The three cells of one column are next to each other in the order of codes.
            column, bottom, top = (spot[:, 0] + dx) * width, np.clip(spot[:, 1], 0, width - 1), np.clip(spot[:, 1] + 2, 0, width - 1)
            first, last = np.searchsorted(code, column + bottom, "left"), np.searchsorted(code, column + top, "right")
            _among(a, b, first, last, order, rest, best, at)
        rest = rest[best[rest] > side]
        side *= 2
    _among(a, b, np.zeros(len(rest), np.int64), np.full(len(rest), len(b)), every, rest, best, at)
    return best, at


def _linked(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """(det_id, distance, next_id) of two frames' links, each given as det_id and places."""
    by = np.argsort(b[0], kind="stable")
    ids, other = a[0], b[0][by]
    far, at = nearest(a[1], b[1][by])
    want = other[at]
    for first in ((want, far, ids), (ids, far, want)):  # one link of each det_id, then one of each next_id
        by = np.lexsort(first)
        key = first[2][by]
        by = by[np.append(True, key[1:] != key[:-1])]
        ids, far, want = ids[by], far[by], want[by]
    return ids, far, want


_NAMES = ("recording_id", "frame", "det_id", "distance", "next_id")


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows that come by recording, block and frame."""
    before: tuple | None = None
    now: tuple | None = None
    out: list[tuple[np.ndarray, ...]] = []

    def close() -> None:
        """Link the frame that is complete to the one before it."""
        nonlocal before
        if now is None:
            return
        key, frame = now[0], tuple(np.concatenate(c) for c in zip(*now[1], strict=True))
        if before is not None and before[0] == (*key[:2], key[2] - 1):
            links = _linked(before[1], frame)
            out.append((np.full(len(links[0]), key[0]), np.full(len(links[0]), key[2] - 1), *links))
        before = (key, frame)

    def drained(least: int) -> Iterator[pa.RecordBatch]:
        if out and sum(len(r[0]) for r in out) >= least:
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=list(_NAMES))
            out.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in ("recording_id", "block", "frame")])
        ids, places = batch.column("det_id").to_numpy(), np.stack([batch.column(c).to_numpy() for c in "xy"], axis=1)
        begins = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))).tolist()
        for i, j in zip(begins, [*begins[1:], batch.num_rows], strict=True):
            own = tuple(key[:, i].tolist())
            if now is None or now[0] != own:
                close()
                now = (own, [])
            now[1].append((ids[i:j], places[i:j]))
        yield from drained(50_000)
    close()
    yield from drained(1)


def link_consecutive(detections: DataFrame) -> DataFrame:
    """Link each detection to the nearest of the next frame; of several that want the same one the closest has it.

    Ties go to the smaller ``det_id``. Blocks of consecutive frames are dealt over the tasks, so that a detection is
    shuffled once, or twice at a block's border; a task holds two frames. Detections without a place link with nothing.
    """
    known = " and ".join(f"{c} is not null" for c in ("recording_id", "frame", "det_id", "x", "y")) + " and abs(x) < double('inf') and abs(y) < double('inf')"
    rows = detections.select(*[F.col(c).cast("long").alias(c) for c in ("recording_id", "frame", "det_id")], *[F.col(c).cast("double").alias(c) for c in "xy"]).where(known)
    own = F.floor(F.col("frame") / BLOCK)
    rows = rows.withColumn("block", F.explode(F.array_compact(F.array(own, F.when(F.col("frame") % BLOCK == 0, own - 1)))))
    ordered = rows.repartition("recording_id", "block").sortWithinPartitions("recording_id", "block", "frame")
    return ordered.mapInArrow(_link, "recording_id long, frame long, det_id long, distance double, next_id long")


def _cells(frame: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """A number for each cell of each frame. Cells may share one, which only costs time."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    return (frame.astype(np.uint64) * odd + cx.astype(np.int64).astype(np.uint64)) * odd + cy.astype(np.int64).astype(np.uint64)


def holding(boxes: dict[str, np.ndarray], marks: dict[str, np.ndarray]) -> np.ndarray:
    """Which boxes hold a marker of their frame. ``marks`` come by frame.

    A box is looked up in the cells of a grid whose side is a power of two above its own, of which it touches four at
    most. Boxes without finite bounds meet all markers of the frame. NaN is above all numbers, as in SQL.
    """
    frame, x, y, w, h, cos, sin = (boxes[c] for c in ("number", "x", "y", "half_width", "half_height", "cos", "sin"))
    of, mx, my = (marks[c] for c in ("number", "x", "y"))
    found = np.zeros(len(x), bool)

    def compare(own: np.ndarray, first: np.ndarray, last: np.ndarray, order: np.ndarray) -> None:
        for i, k in _spread(first, last):
            i, k = own[i], order[k]
            dx, dy = mx[k] - x[i], my[k] - y[i]
            along, across = np.abs(dx * cos[i] + dy * sin[i]), np.abs(dy * cos[i] - dx * sin[i])
            inside = (frame[i] == of[k]) & ((along <= w[i]) | np.isnan(w[i])) & ((across <= h[i]) | np.isnan(h[i]))
            found[i[inside]] = True

    with np.errstate(invalid="ignore", over="ignore"):
        ex, ey = np.abs(w * cos) + np.abs(h * sin), np.abs(w * sin) + np.abs(h * cos)
        # A margin keeps rounding at a box's edge inside its cells; far from the origin cells are larger, so that their numbers stay exact.
        margin = np.maximum(ex, ey) * 1e-6 + 1e-6
        ex, ey = ex + margin, ey + margin
        far = np.maximum(np.abs(x), np.abs(y))
        side = 2.0 ** np.ceil(np.log2(np.maximum(np.maximum(ex, ey), far * 2.0**-25) * 2))
        bounds = {"x": (x - ex, x + ex), "y": (y - ey, y + ey)}
        finite = np.isfinite(side) & np.isfinite(sum(np.abs(v) for pair in bounds.values() for v in pair))
        own = np.flatnonzero(~finite)
        compare(own, np.searchsorted(of, frame[own], "left"), np.searchsorted(of, frame[own], "right"), np.arange(len(of)))
        here = np.flatnonzero(np.isfinite(mx) & np.isfinite(my))
        for s in np.unique(side[finite]).tolist():
            code = _cells(of[here], *(np.floor(np.clip(m[here] / s, -(2.0**40), 2.0**40)) for m in (mx, my)))
            order = np.argsort(code, kind="stable")
            code, order = code[order], here[order]
            own = np.flatnonzero(finite & (side == s))
            low, high = ({c: np.floor(v[k] / s) for c, v in bounds.items()} for k in (0, 1))
            for right, top in ((0, 0), (1, 0), (0, 1), (1, 1)):
                # The second column or row of cells is looked up where it is another one.
                rest = own[~found[own] & ((high["x"] > low["x"])[own] | (not right)) & ((high["y"] > low["y"])[own] | (not top))]
                cell = _cells(frame[rest], (high if right else low)["x"][rest], (high if top else low)["y"][rest])
                compare(rest, np.searchsorted(code, cell, "left"), np.searchsorted(code, cell, "right"), order)
    return found


_BOX, _PLACE = ("half_width", "half_height", "cos", "sin"), ("x", "y")


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of boxes that hold a marker; rows come by frame, in each the markers first."""
    last, held = None, {c: np.empty(0) for c in _PLACE}  # the markers of the last frame
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c) for c in ("recording_id", "frame")]
        new = np.zeros(batch.num_rows, np.int64)
        for k in keys:
            new[1:] |= pc.not_equal(k.slice(1), k.slice(0, len(k) - 1)).to_numpy(zero_copy_only=False)
        new[0] = last is not None and last != [k[0] for k in keys]
        number = np.cumsum(new)  # 0 is the last frame of the batch before, if there is one
        marker = batch.column("marker").to_numpy(zero_copy_only=False)
        column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _PLACE + _BOX}
        marks = {c: np.append(held[c], column[c][marker]) for c in _PLACE} | {"number": np.append(np.zeros(len(held["x"]), np.int64), number[marker])}
        # Equal markers are compared once.
        by = np.lexsort((marks["y"], marks["x"], marks["number"]))
        marks = {c: v[by] for c, v in marks.items()}
        other = np.append(True, np.any([v[1:] != v[:-1] for v in marks.values()], axis=0))[: len(by)]
        marks = {c: v[other] for c, v in marks.items()}
        if not marker.all():
            kept = np.flatnonzero(~marker)
            kept = kept[holding({c: v[kept] for c, v in column.items()} | {"number": number[kept]}, marks)]
            if len(kept):
                yield pa.RecordBatch.from_struct_array(batch.column("row").take(pa.array(kept)))
        last, held = [k[len(k) - 1] for k in keys], {c: marks[c][marks["number"] == number[-1]] for c in _PLACE}


def link_marked(candidates: DataFrame, markers: DataFrame) -> DataFrame:
    """Candidates whose box (turned by its angle) contains the centre of a marker of the same frame.

    Boxes and markers are shuffled once, by frame, and not at all where both come by frame already; a task holds the
    markers of one frame. Boxes and markers with NULLs meet nothing.
    """
    keys, a = ["recording_id", "frame"], F.radians("degrees_angle")
    place = [F.col(c).cast("double").alias(c) for c in _PLACE]
    shape = [v.cast("double").alias(c) for c, v in zip(_BOX, (F.col("width") / 2, F.col("height") / 2, F.cos(a), F.sin(a)), strict=True)]
    known = lambda df, names: df.where(" and ".join(f"{c} is not null" for c in names))
    boxes = known(candidates.select(*keys, *place, *shape, F.lit(False).alias("marker"), F.struct(*candidates.columns).alias("row")), [*keys, *_PLACE, *_BOX])
    marks = known(markers.select(*keys, *place, F.lit(True).alias("marker")), [*keys, *_PLACE])
    # Frames without markers are left out. The window deals rows by frame, markers first.
    first = F.first("marker").over(Window.partitionBy(*keys).orderBy(F.desc("marker")))
    rows = boxes.unionByName(marks, allowMissingColumns=True).withColumn("marked", first).where("marked").drop("marked")
    return rows.mapInArrow(_keep, candidates.schema)


keep_marked = link_marked
