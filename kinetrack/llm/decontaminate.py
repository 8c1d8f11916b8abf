"""Benchmark decontamination with suffix arrays over the training text.

Each task builds suffix arrays (shards) of the words of its documents and binary-searches the benchmark
items' suffixes in them. The neighbours of the insertion point give the longest verbatim match
of that suffix in the shard, and the range of suffixes that share a whole window gives its locations.
Only document words in runs of the benchmark's own words that are as long as the shortest window can
begin a match, so only those enter a shard. Of the items' suffixes only those whose first words stand
together in the shard can be found there: they are looked up by the shard's own stretches of words in a list
that is sorted once, so the work follows the text, not the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

WINDOW = 10
#: First words by which the items' suffixes are looked up.
HEAD = 5
#: Characters of benchmark text that are sent to the tasks at once; a longer benchmark is searched in blocks.
BLOCK_CHARS = 4_000_000

SPANS = "array<struct<start:long,end:long,item:string>>"


class Items:
    """The words of a block of benchmark items as ranks in their own vocabulary, and their windows."""

    def __init__(self, rows: list[tuple[str, str]], window: int):
        self.names = [name for name, _ in rows]
        data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for _, t in rows])]).astype(np.int64)
        w = W.split(data, offsets, W.ALNUM)
        self.vocabulary, ranks = np.unique(w.hash, return_inverse=True)
        self.window, n = window, np.diff(w.first)
        count = np.where(n >= window, n - window + 1, np.minimum(n, 1))
        self.item = np.repeat(np.arange(len(rows)), count)
        self.length = np.minimum(n, window)[self.item]
        self.at = W.ranges(w.first[:-1], count)
        self.ranks = np.concatenate([ranks + 1, np.zeros(window, np.int64)])
        self.least = int(self.length.min()) if len(self.length) else 0
        self.left = w.first[self.item + 1] - self.at  # words from a window's first to its item's end
        # For each number of first words: the windows by the hash of those.
        self.heads: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        k_of = np.minimum(self.length, HEAD)
        for k in np.unique(k_of).tolist():
            own = np.flatnonzero(k_of == k)
            head = stretch_hashes(self.ranks, self.at[own], k)
            order = np.argsort(head, kind="stable")
            self.heads[k] = head[order], own[order]

    def present(self, shard: np.ndarray) -> np.ndarray:
        """Windows whose first words stand together in the shard."""
        found = [np.zeros(0, np.int64)]
        for k, (heads, windows) in self.heads.items():
            known = np.append(shard, np.zeros(k - 1, np.int64)) > 0
            at = np.flatnonzero(np.logical_and.reduce([known[j : j + len(shard)] for j in range(k)]))
            names = np.unique(stretch_hashes(np.append(shard, np.zeros(k, np.int64)), at, k))
            low, high = np.searchsorted(heads, names), np.searchsorted(heads, names, "right")
            found.append(windows[W.ranges(low, high - low)])
        return np.sort(np.concatenate(found))


def stretch_hashes(ranks: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k ranks from each place on."""
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h = W.mix(h ^ ranks[at + j].astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
    return h


def suffix_array(ranks: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``ranks`` sorted by their first ``depth`` values at least, by prefix doubling; and their order names."""
    name = np.unique(ranks, return_inverse=True)[1].astype(np.int64)
    done = 1
    while done < depth:
        after = np.zeros(len(name), np.int64)
        after[: len(name) - done] = name[done:] + 1
        name = np.unique(name * (len(name) + 1) + after, return_inverse=True)[1]
        done *= 2
    return np.argsort(name, kind="stable"), name


def find_matches(ranks: np.ndarray, doc: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word position, window, verbatim length) of all occurrences of the items' windows in one shard.

    ``ranks`` has 0 where no window can go on. ``verbatim`` is the longest common prefix of the item's
    suffix and the text at that position.
    """
    array, _ = suffix_array(ranks, items.window)
    array = array[ranks[array] > 0]
    padded = np.concatenate([ranks, np.zeros(2 * items.window + 1, np.int64)])
    own = np.concatenate([items.ranks, np.zeros(2 * items.window + 1, np.int64)])
    chosen = items.present(ranks)
    begin, length = items.at[chosen], items.length[chosen]

    def bound(upper: bool) -> np.ndarray:
        """Binary search of the chosen item suffixes among the sorted suffixes, all at once."""
        low, high = np.zeros(len(begin), np.int64), np.full(len(begin), len(array))
        while (open_ := low < high).any():
            mid = (low + high) // 2
            order, same = np.zeros(len(low), np.int8), np.ones(len(low), bool)
            here = array[np.minimum(mid, len(array) - 1)]
            for j in range(items.window):
                a, b = padded[here + j], own[begin + j]
                same &= j < length
                order = np.where(same & (a != b), np.where(a < b, -1, 1), order).astype(np.int8)
                same &= a == b
            goes_up = open_ & ((order < 0) | ((order == 0) & upper))
            low, high = np.where(goes_up, mid + 1, low), np.where(open_ & ~goes_up, mid, high)
        return low

    if not len(array) or not len(chosen):
        return (np.zeros(0, np.int64),) * 3
    low = bound(False)
    count = bound(True) - low
    window = np.repeat(chosen, count)
    where = array[W.ranges(low, count)]
    verbatim, going, j = np.zeros(len(where), np.int64), np.arange(len(where)), 0
    while len(going):  # the matches that still go on
        x, y = where[going] + j, items.at[window[going]] + j
        same = (j < items.left[window[going]]) & (x < len(ranks)) & (y < len(items.ranks))
        same &= (padded[np.minimum(x, len(padded) - 1)] == own[np.minimum(y, len(own) - 1)]) & (padded[np.minimum(x, len(padded) - 1)] > 0)
        going, j = going[same], j + 1
        verbatim[going] = j
    return where, window, verbatim


def _search(texts: pa.Array, items: Items) -> Iterator[tuple[int, int, list]]:
    """For consecutive rows: (first row, words of each, spans of each)."""
    for a, b, data, offsets in W.raw_chunks(texts):
        w = W.split(data, offsets, W.ALNUM)
        n_words = np.diff(w.first)
        spans: list[list] = [[] for _ in range(b - a)]
        if items.least and len(w.hash):
            found = np.minimum(np.searchsorted(items.vocabulary, w.hash), len(items.vocabulary) - 1)
            ranks = np.where(items.vocabulary[found] == w.hash, found + 1, 0)
            doc = np.repeat(np.arange(b - a), n_words)
            # Runs of benchmark words inside one document; only long enough ones can hold a window.
            known = ranks > 0
            begins = np.flatnonzero(known & np.concatenate([[True], ~known[:-1] | (doc[1:] != doc[:-1])]))
            stops = np.flatnonzero(known & np.concatenate([~known[1:] | (doc[1:] != doc[:-1]), [True]])) + 1
            keep = stops - begins >= items.least
            begins, lengths = begins[keep], (stops - begins)[keep]
            # Each run is followed by a 0, which no window contains.
            at = W.ranges(begins, lengths + 1)
            last = np.cumsum(lengths + 1) - 1
            at[last] = -1
            shard = np.where(at >= 0, ranks[at], 0)
            where, window, verbatim = find_matches(shard, doc, items)
            position = at[where]
            for p, x, v in zip(position.tolist(), window.tolist(), verbatim.tolist(), strict=True):
                d = int(doc[p])
                spans[d].append((p - int(w.first[d]), p - int(w.first[d]) + max(v, int(items.length[x])), items.names[int(items.item[x])]))
        yield a, n_words.tolist(), spans


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_chars: int) -> Iterator[Items]:
    """Benchmark items in blocks of bounded size; items with a null text, a null id or no words match nothing."""
    rows, held = [], 0
    for r in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").toLocalIterator():
        rows.append((r["i"], r["t"]))
        held += len(r["t"])
        if held >= block_chars:
            yield Items(rows, window)
            rows, held = [], 0
    if rows:
        yield Items(rows, window)


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Add ``n_words`` (long) and ``spans`` to ``docs``: each occurrence of a benchmark window.

    A span is (first word, end word, item id) with the longest verbatim match from that word. Words are ASCII lower-cased runs of letters, digits and non-ASCII characters. An
    item of fewer words than ``window`` is one window; null texts have no words. Columns of ``docs`` named
    like the added ones are replaced; repeated rows each get their spans, items that share a window one each. A very
    long text is a shard of its own. An empty benchmark gives empty spans, empty documents an empty table.
    """
    out = docs.drop("n_words", "spans").withColumns({"n_words": F.lit(None).cast("long"), "spans": F.array().cast(SPANS)})
    spark = docs.sparkSession
    blocks = item_blocks(benchmark, item_id, item_text, window, block_chars)
    for items in chain([next(blocks, Items([], window))], blocks):
        sent = spark.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                before = batch.column("spans").to_pylist()
                for a, n_words, spans in _search(batch.column(text_col), sent.value):
                    rows = batch.slice(a, len(n_words))
                    joined = [x + [dict(zip(("start", "end", "item"), y, strict=True)) for y in s] for x, s in zip(before[a : a + len(n_words)], spans, strict=True)]
                    rows = rows.set_column(rows.schema.get_field_index("n_words"), "n_words", pa.array(n_words, pa.int64()))
                    yield rows.set_column(rows.schema.get_field_index("spans"), rows.schema.field("spans"), pa.array(joined, rows.schema.field("spans").type))

        out = out.mapInArrow(search, out.schema)
    return out


def hits(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """``n_hit``, ``items`` and ``contaminated`` from the spans: words inside any occurrence count once."""
    # Spans sorted by start are folded into the number of words that they cover.
    covered = F.aggregate(
        F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b")))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(s["a"], acc["to"]))).alias("n"), F.greatest(acc["to"], s["b"]).alias("to")),
        lambda acc: acc["n"],
    )
    return found.withColumns({"n_hit": covered, "items": F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item"])))}).withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with their own columns and values, whatever their names."""
    kept, spark = docs, docs.sparkSession
    for items in item_blocks(benchmark, "item_id", "text", window, BLOCK_CHARS):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not s for _, _, spans in _search(batch.column(text_col), sent.value) for s in spans]
                yield batch.filter(pa.array(clean, pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
