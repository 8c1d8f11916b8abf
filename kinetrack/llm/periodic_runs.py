"""Periodic runs of words inside documents: Kruskal over suffix classes by descending common prefix.

A run is a stretch with smallest period q that no neighbour extends. Suffixes of a document that share their
first l words form a class; going down from the largest l, neighbours of the suffix array that share l words
unite their classes. Each class keeps its positions in order. Where a union makes two positions i < j
neighbours and j - i <= l, the words from i to j + l have smallest period j - i: a smaller one would put a
position of the same class between them. Every run is met so at its own start, and all its other seeds end
where it ends, so the least seed of each (period, end) is the run.

A run of at least ``least`` words has a start and its repetition that share half as many words. Only
positions whose first ``least / 2`` words recur in the document can begin one, so only the stretches that
those words cover enter the suffix array.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import words as W

#: Words of the shortest run.
LEAST = 12
RUNS = "array<struct<start:long,length:long,period:long>>"


def _recurring(names: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Places whose k words from there on occur again in the same document."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    at = W.ranges(first[:-1], count)
    key = W.mix(np.repeat(np.arange(len(count), dtype=np.uint64), count))
    for j in range(k):
        key = (key ^ names[at + j]) * np.uint64(0xFF51AFD7ED558CCD) + (key >> np.uint64(31))
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    return at[np.isin(key, twice)] if len(twice) else at[:0]


def suffix_levels(names: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... values until no two are equal; one more entry stands for the end."""
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64)
    levels, done = [np.append(rank, -1)], 1
    while rank.max() + 1 < len(rank):
        after = np.zeros(len(rank), np.int64)
        after[: max(0, len(rank) - done)] = rank[done:] + 1
        rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1].astype(np.int64)
        levels.append(np.append(rank, -1))
        done *= 2
    return levels


def neighbour_prefixes(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and how many values each suffix shares with the next one."""
    array = np.argsort(levels[-1][:-1], kind="stable")
    i, j = array[:-1].copy(), array[1:].copy()
    shared = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 2, -1, -1):
        same = levels[k][i] == levels[k][j]
        shared[same] += 1 << k
        i, j = np.where(same, i + (1 << k), i), np.where(same, j + (1 << k), j)
    return array, shared


def unite(array: np.ndarray, shared: np.ndarray, least: int) -> dict[tuple[int, int], int]:
    """(period, end) -> start of the stretches that unions of suffix classes seed, down to ``least`` shared values."""
    order = np.flatnonzero(shared >= least)
    order = order[np.argsort(-shared[order], kind="stable")]
    parent: dict[int, int] = {}
    held: dict[int, list[int]] = {}
    found: dict[tuple[int, int], int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    def seed(i: int, j: int, l: int) -> None:  # noqa: E741
        key = (j - i, j + l)
        if i < found.get(key, i + 1):
            found[key] = i

    for l, a, b in zip(shared[order].tolist(), array[order].tolist(), array[order + 1].tolist(), strict=True):  # noqa: E741
        a, b = top(a), top(b)
        large, small = held.get(a) or [a], held.pop(b, None) or [b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
            held.pop(b, None)
        parent[b], held[a] = a, large
        places = [bisect_left(large, x) for x in small]
        for n, (x, k) in enumerate(zip(small, places, strict=True)):
            # Of several that come between the same two, only the outer ones are new neighbours of those.
            if k and (not n or places[n - 1] < k) and x - large[k - 1] <= l:
                seed(large[k - 1], x, l)
            if k < len(large) and (n + 1 == len(small) or places[n + 1] > k) and large[k] - x <= l:
                seed(x, large[k], l)
        if 8 * len(small) < len(large):
            for x in small:
                insort(large, x)
        else:
            large += small
            large.sort()
    return found


def find_runs(names: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words, period) of all runs of documents whose words have ``names``, by first word and period."""
    half = (least + 1) // 2
    active = _recurring(names, first, half)
    if not len(active):
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(len(names) + 1, np.int64)
    np.add.at(edge, active, 1)
    np.add.at(edge, active + half, -1)
    place = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    doc = np.searchsorted(first, place, "right")
    # A value of its own follows each covered stretch.
    cut = np.append((place[1:] != place[:-1] + 1) | (doc[1:] != doc[:-1]), True)
    spot = np.arange(len(place)) + np.concatenate([[0], np.cumsum(cut)[:-1]])
    own = np.unique(W.mix(names[place] ^ W.mix(doc.astype(np.uint64))), return_inverse=True)[1]
    line = np.zeros(len(place) + int(cut.sum()), np.int64)
    line[spot] = own
    ends = spot[cut] + 1
    line[ends] = len(place) + np.arange(len(ends))
    back = np.zeros(len(line), np.int64)
    back[spot] = place
    seeds = unite(*neighbour_prefixes(suffix_levels(line)), half)
    runs = sorted((int(back[i]), end - i, period) for (period, end), i in seeds.items() if end - i >= max(least, 2 * period))
    return tuple(np.array(c, np.int64) for c in zip(*runs, strict=True)) if runs else (np.zeros(0, np.int64),) * 3


def _same_words(w: W.Words, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bool:
    """Whether the words one period apart are the same bytes everywhere in the runs."""
    i = W.ranges(start, length - period)
    j = i + np.repeat(period, length - period)
    size = w.end[i] - w.start[i]
    if (size != w.end[j] - w.start[j]).any():
        return False
    return bool((w.data[W.ranges(w.start[i], size)] == w.data[W.ranges(w.start[j], size)]).all())


def _exact_names(w: W.Words) -> np.ndarray:
    raw, known = w.data.tobytes(), {}
    return np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)), np.uint64, len(w.start))


def word_runs(w: W.Words, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``find_runs`` of words that are told apart by their hashes, and by their bytes where two hashes are equal by chance."""
    found = find_runs(w.hash, w.first, least)
    return found if _same_words(w, *found) else find_runs(_exact_names(w), w.first, least)


def joined_words(w: W.Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each document with one space between them."""
    at = np.flatnonzero(keep)
    before = np.searchsorted(at, w.first)
    size = w.end[at] - w.start[at] + 1
    last = before[1:][before[1:] > before[:-1]] - 1
    stop = np.cumsum(size)
    data = np.append(w.data, np.uint8(32))[W.ranges(w.start[at], size)] if len(at) else np.zeros(0, np.uint8)
    data[stop - 1] = 32
    spaced = np.ones(len(data), bool)
    spaced[stop[last] - 1] = False
    total = np.concatenate([[0], stop])
    offsets = total[before] - np.searchsorted(last, before)
    return pa.Array.from_buffers(pa.large_string(), len(before) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[spaced])]).cast(pa.string())


def _run_batches(text_col: str, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in W.raw_chunks(batch.column(text_col)):
                w = W.split(data, offsets, W.SPACED, lower=False)
                start, length, period = word_runs(w, least)
                edge = np.zeros(len(w.start) + 1, np.int64)
                np.add.at(edge, start + period, 1)
                np.add.at(edge, start + length, -1)
                doc = np.searchsorted(w.first, start, "right") - 1
                parts = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array(start - w.first[doc]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
                rows = batch.slice(a, b - a).drop_columns([text_col])
                columns = [*rows.columns, pa.array(np.diff(w.first)), pa.ListArray.from_arrays(pa.array(parts), spans), joined_words(w, np.cumsum(edge[:-1]) == 0)]
                yield pa.record_batch(columns, names=[*rows.schema.names, "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row: its periodic runs of words and the text without their repetitions.

    Words are runs of characters other than space and 09 to 0D, as they are. ``runs`` has (start, length, period)
    of each run of at least ``least`` words and two periods, by start and then period; overlapping runs are all
    listed. ``collapsed`` joins by one space the words that are in no run after its first period.

    Null and empty texts have no words, no runs and an empty ``collapsed``. Repeated rows and ids each keep their
    row, other columns are not read, an empty table gives an empty one. Documents are independent of each other;
    one is held by one task, with about 100 bytes of memory for each of its bytes that recurs.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = StructType([rows.schema["doc_id"], *StructType.fromDDL(f"n_words long, runs {RUNS}, collapsed string")])
    return rows.mapInArrow(_run_batches("text", least), out)
