"""Packing documents into sequences by order-preserving dynamic programming.

Documents are put in order of their ids and their tokens form one stream per partition. Windows of at
most ``limit`` tokens are cut from the stream so that padding plus penalties for cutting a document are
least. Cuts are possible after documents (free), after sentences (a small penalty) and, inside sentences
longer than ``GRID`` tokens, at every ``GRID``-th token (a larger one). The best window before each place
is the smallest of cost plus position over the last ``limit`` tokens, which a monotone queue keeps.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tokens import encoder

LIMIT = 2048
END_ID = 1
GRID = 64
SENTENCE_PENALTY, INSIDE_PENALTY = 16, 64
#: Tokens for which cuts are chosen at once; the last window goes on with the tokens that follow.
BLOCK = 1 << 18

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def choose_cuts(places: list[int], penalties: list[int], limit: int = LIMIT) -> list[int]:
    """The cheapest cuts, as places, the last place included.

    ``places`` ascend from above 0 in steps of at most ``limit``; a window from i to j costs the padding
    ``limit - (j - i)`` plus the penalty of j. The last place costs no padding: its window stays open.
    """
    queue: deque[tuple[int, int, int]] = deque([(0, 0, -1)])  # (cost + place, place, index), ascending in both
    back = [0] * len(places)
    last = len(places) - 1
    for j, (place, penalty) in enumerate(zip(places, penalties, strict=True)):
        while place - queue[0][1] > limit:
            queue.popleft()
        # The last window costs nothing, so its start has the least cost itself; what left the queue has no less.
        best, _, back[j] = queue[0] if j < last else min(queue, key=lambda q: (q[0] - q[1], -q[1]))
        value = best + limit + penalty  # the cost of a cut here, plus its place
        if j < last:
            while queue and queue[-1][0] >= value:
                queue.pop()
            queue.append((value, place, j))
    cuts, j = [], last
    while j >= 0:
        cuts.append(places[j])
        j = back[j]
    return cuts[::-1]


def tail_lengths(n: int, limit: int = LIMIT) -> list[int]:
    """Sequences of the last tokens of a partition: one padded sequence, or powers of two without padding."""
    if n == 0:
        return []
    powers = [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]
    return powers if (len(powers) - 1) * INSIDE_PENALTY < limit - n else [n]


def candidate_places(counts: np.ndarray, closes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (token positions) and penalties from consecutive pieces.

    ``counts`` are the tokens of each piece, ``closes`` marks pieces that end a sentence and ``ends``
    those that end a document, the last one included.
    """
    own = closes | ends
    places = np.cumsum(counts)[own]
    penalty = np.where(ends[own], 0, SENTENCE_PENALTY)
    gaps = np.diff(places, prepend=0)
    more = (gaps - 1) // GRID
    if more.any():
        grid = np.repeat(places - gaps, more) + GRID * (W.ranges(np.zeros(len(more), np.int64), more) + 1)
        at = np.repeat(np.arange(len(places)), more)
        places, penalty = np.insert(places, at, grid), np.insert(penalty, at, INSIDE_PENALTY)
    return places, penalty


class Packer:
    """Packs the documents of one partition, a block of tokens at a time."""

    def __init__(self, limit: int, first_sequence: int):
        self.limit, self.sequence = limit, first_sequence
        self._empty()

    def _empty(self) -> None:
        self.held = 0
        self.ids, self.places, self.penalties = [], [], []
        self.docs, self.sizes, self.starts, self.ends = [], [], [], []

    def add(self, docs: list, ids: np.ndarray, sizes: np.ndarray, places: np.ndarray, penalties: np.ndarray, starts: np.ndarray | None = None, whole: np.ndarray | None = None) -> None:
        """Documents' tokens one after another; ``sizes`` of them are here, from ``starts`` on, of ``whole`` in all."""
        self.docs += docs
        self.ids.append(ids)
        self.ends.append(self.held + np.cumsum(sizes))
        self.sizes.append(sizes if whole is None else whole)
        self.starts.append(np.zeros(len(sizes), np.int64) if starts is None else starts)
        self.places.append(self.held + places)
        self.penalties.append(penalties)
        self.held += len(ids)

    def flush(self, final: bool) -> list[list]:
        """Columns of the finished windows' pieces; the open window's tokens stay unless ``final``."""
        if not self.held:
            return []
        places, penalties, ids = np.concatenate(self.places), np.concatenate(self.penalties), np.concatenate(self.ids)
        sizes, starts, ends, docs = np.concatenate(self.sizes), np.concatenate(self.starts), np.concatenate(self.ends), self.docs
        stops = choose_cuts(places.tolist(), penalties.tolist(), self.limit)[:-1]
        upto = stops[-1] if stops else 0
        if final:
            stops += [upto + int(x) for x in np.cumsum(tail_lengths(self.held - upto, self.limit))]
            upto = self.held
        begins = np.concatenate([[0], ends[:-1]])
        out: list[list] = []
        if upto:
            stops_ = np.array(stops)
            edges = np.union1d(np.concatenate([[0], stops_]), begins[begins < upto])
            doc = np.searchsorted(begins, edges[:-1], "right") - 1
            window = np.searchsorted(stops_, edges[:-1], "right")
            raw = memoryview(np.ascontiguousarray(ids[:upto], "<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            opens = np.concatenate([[0], stops_])[window]
            out = [[docs[d] for d in doc.tolist()], starts[doc] + edges[:-1] - begins[doc], np.diff(edges), crc, sizes[doc], self.sequence + window, edges[:-1] - opens]
            self.sequence += len(stops)
        d = int(np.searchsorted(ends, upto, "right"))  # the first document that goes on
        self._empty()
        if d < len(docs):
            begin, later = np.maximum(begins[d:], upto), places > upto
            self.add(docs[d:], ids[upto:], ends[d:] - begin, places[later] - upto, penalties[later], starts[d:] + begin - begins[d:], sizes[d:])
        return out


def _pack(path: Callable[[], str] | str, limit: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def batch_of(columns: list[list]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path() if callable(path) else path)
        packer = Packer(limit, TaskContext.get().partitionId() << 40)
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            for a, b, data, offsets in W.raw_chunks(batch.column("text"), 1 << 19):
                codes, parts = own.codes(data, offsets)
                # After each document's pieces comes one that has the closing id alone.
                last = np.cumsum(parts)
                counts, closes = np.insert(own.count[codes], last, 1), np.insert(own.closes[codes], last, False)
                ends = np.zeros(len(counts), bool)
                ends[last + np.arange(b - a)] = True
                total = np.cumsum(counts)
                ids = np.full(int(total[-1]), END_ID, np.uint32)
                ids[W.ranges((total - counts)[~ends], counts[~ends])] = own.ids[W.ranges(own.start[codes], counts[~ends])]
                packer.add(docs[a:b], ids, np.diff(total[ends], prepend=0), *candidate_places(counts, closes, ends))
                if packer.held >= block and (found := packer.flush(final=False)):
                    yield batch_of(found)
        if found := packer.flush(final=True):
            yield batch_of(found)

    return pack


def pack_documents(docs: DataFrame, path: Callable[[], str] | str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its token ids and then ``END_ID``; a null text is empty and so has that id alone. Each
    id lies in one piece; pieces of a sequence have gapless offsets. Sequence ids are unique, not gapless.
    Null and repeated ids are packed like others, and rows of one id, equal ones too, may lie in several tasks. A very
    long text is cut into many sequences; one task encodes it, a block of tokens at a time. Cuts of equal penalty go to
    the one found first. Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Rows of one id, equal ones too, may lie in several tasks.
    keys = ["doc_id", "hash", "row"]
    keyed = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    return ordered.mapInArrow(_pack(path, limit, block), SCHEMA)
