"""N-gram Jaccard join by T-occurrence search (DivideSkip) over a sharded inverted index.

1. *Index.* Tasks turn documents into sets of shingle hashes and send each hash, with a short document
   number, to the index shard of its bucket: sorted and packed, one row per task batch and bucket. A hash
   that many documents of a batch share travels once for each distinct set.
2. *Lists.* A shard merges its packed rows, so each hash has its inverted list. Only lists with two
   documents or more can add to an overlap; their hashes return to the documents with the list lengths.
3. *Short lists.* With ``n`` hashes a document needs ``T = ceil(0.8 n)`` in common with any partner, so it
   must meet every partner in one of its ``n - T + 1`` shortest lists (the hash breaks ties). Most
   documents have that many hashes of their own and meet nobody.
4. *Search.* Documents that meet are gathered in neighbourhoods, cut into blocks of bounded size, and
   every pair of blocks of a neighbourhood is searched by DivideSkip: the short lists are merged, the
   longest are set aside and probed by binary search, documents with the required overlap are kept. A task
   returns links that connect its documents, not all pairs.
5. Links between sets give components; equal sets are one node from the start.

Hashes have 64 bits: two different shingles of the compared documents are taken for one with a
probability of about 2 ** -64 for each pair of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .packed import pack, pack_sorted, unpack, unpack_sorted
from .tables import min_label, written

K = 5
#: Least similarity as a ratio of integers.
NUMERATOR, DENOMINATOR = 80, 100
#: Bytes of text for each index shard, about; shingle hashes of a batch; bytes of sets in a block.
SHARD_BYTES, BATCH_HASHES, BLOCK_BYTES = 4 << 20, 1 << 20, 4 << 20
LEAST_SHARDS = 64
#: DivideSkip's mu, tuned: 800 near copies of 300 shingles took 2.3 s at 0.0085, 3.5 s at 0.1 and 6.1 s at 1; look-ups at once.
MU, PROBES = 0.01, 1 << 16


def least_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """Hashes that a set of ``n`` must share with any partner."""
    return -(-n * NUMERATOR // DENOMINATOR)


def document_sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For consecutive rows: (first, last, sorted distinct hashes of all, set sizes, 63-bit set ids). Empty sets have id 0."""
    for a, b, data, offsets in W.raw_chunks(texts):
        h, first = W.shingles(W.split(data, offsets, W.SPACED), K)
        parts = [np.unique(x) for x in np.split(h, first[1:-1])]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        # A set's id: sums of two mixes of its hashes, so that equal sets have equal ids in any order.
        ends = np.cumsum(sizes)
        one, two = (np.concatenate([[np.uint64(0)], np.cumsum(W.mix(values ^ np.uint64(c)), dtype=np.uint64)]) for c in (0x51ED2701, 0x9D3C5A17))
        ids = W.mix((one[ends] - one[ends - sizes]) ^ W.mix((two[ends] - two[ends - sizes]) + sizes.astype(np.uint64)))
        ids = np.where(sizes > 0, (ids >> np.uint64(1)) | np.uint64(1), np.uint64(0)).astype(np.int64)
        yield a, b, values, sizes, ids


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, _, sizes, ids in document_sets(batch.column("text")):
            yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(sizes), pa.array(ids)], names=["doc_id", "n_shingles", "set_id"])


_INDEX = "bucket long, batch long, hashes binary, docs binary, counts binary, sets binary, repeated binary, holders binary"


def _index_rows(buckets: int):
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def flush(held: list, number: int) -> Iterator[pa.RecordBatch]:
        values, sizes, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        # Each distinct set of the batch is one document of it.
        ids, chosen = np.unique(ids, return_index=True)
        starts = np.cumsum(sizes) - sizes
        n = sizes[chosen]
        values = values[W.ranges(starts[chosen], n)]
        doc = np.repeat(np.arange(len(ids), dtype=np.uint32), n)
        order = np.argsort(values, kind="stable")
        values, doc = values[order], doc[order]
        # A hash goes to its shard once, with its number of documents here; the lists of repeated ones stay with the batch.
        at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        counts = np.diff(np.append(at, len(values))).astype(np.uint32)
        many = counts > 1
        listed = W.ranges(at[many], counts[many].astype(np.int64))
        key = int(W.mix(np.array([TaskContext.get().partitionId() * 2**20 + number], np.uint64))[0] >> np.uint64(1))
        own, first = values[at], doc[at]
        home = key % buckets  # the shard that passes on what stays with the batch
        out = {c.split()[0]: [] for c in _INDEX.split(", ")}
        for k, a, b in W.buckets_of(own >> shift, home):
            kept = (pack(np.concatenate([ids, n])), pack_sorted(values[listed]), pack(doc[listed])) if k == home else (None,) * 3
            for c, v in zip(out, (k, key, pack_sorted(own[a:b]), pack(first[a:b]), pack(counts[a:b]), *kept), strict=True):
                out[c].append(v)
        yield _arrow(out, _INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, number = [], 0, 0
        for batch in batches:
            for _, _, values, sizes, ids in document_sets(batch.column("text")):
                own = ids > 0
                held.append((values, sizes[own], ids[own]))
                count += len(values)
                if count >= BATCH_HASHES:
                    yield from flush(held, number)
                    held, count, number = [], 0, number + 1
        if count:
            yield from flush(held, number)

    return run


_KINDS = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _arrow(columns: dict[str, list], schema: str) -> pa.RecordBatch:
    kinds = dict(c.split(" ") for c in schema.split(", "))
    return pa.record_batch([pa.array(columns[c], _KINDS[k]) for c, k in kinds.items()], names=list(kinds))


_SHARED = "batch long, hashes binary, docs binary, lengths binary, sets binary, repeated binary, holders binary"


def _merge_lists(rows: pa.Table) -> pa.Table:
    """One index shard: for each batch, the hashes with two documents or more over all batches, and their list lengths."""
    cells = rows.to_pydict()
    hashes = [unpack_sorted(r) for r in cells["hashes"]]
    every, counts = np.concatenate(hashes), np.concatenate([unpack(r, np.uint32) for r in cells["counts"]])
    order = np.argsort(every, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], np.diff(every[order]) != 0])) if len(every) else np.zeros(0, np.int64)
    length = np.zeros(len(every), np.uint32)
    length[order] = np.repeat(np.add.reduceat(counts[order], at), np.diff(np.append(at, len(every)))) if len(every) else 0
    out = {c.split()[0]: [] for c in _SHARED.split(", ")}
    start = 0
    for key, h, docs, *kept in zip(cells["batch"], hashes, cells["docs"], cells["sets"], cells["repeated"], cells["holders"], strict=True):
        own = length[start : start + len(h)]
        start += len(h)
        keep = own > 1
        if keep.any() or kept[0] is not None:
            for c, v in zip(out, (key, pack_sorted(h[keep]), pack(unpack(docs, np.uint32)[keep]), pack(own[keep]), *kept), strict=True):
                out[c].append(v)
    return pa.Table.from_batches([_arrow(out, _SHARED)])


_MEETING = "set_id long, n long, shared binary, short array<long>"


def _short_lists(rows: pa.Table) -> pa.Table:
    """One batch: its sets with their shared hashes, and their shortest lists where these are shared ones."""
    cells = rows.to_pydict()
    ids, n = unpack(next(s for s in cells["sets"] if s is not None), np.int64).reshape(2, -1)
    h, first, length = (np.concatenate([f(r) for r in cells[c]]) for c, f in (("hashes", unpack_sorted), ("docs", lambda r: unpack(r, np.uint32)), ("lengths", lambda r: unpack(r, np.uint32))))
    order = np.argsort(h)
    h, first, length = h[order], first[order], length[order]
    more = unpack_sorted(next(r for r in cells["repeated"] if r is not None))
    holders = unpack(next(r for r in cells["holders"] if r is not None), np.uint32)
    # The first document of a repeated hash is in both: it is dropped from the single ones.
    single = ~np.isin(h, more)
    lengths = length[np.searchsorted(h, more)] if len(more) else np.zeros(0, np.uint32)
    h, doc, length = np.concatenate([h[single], more]), np.concatenate([first[single], holders]), np.concatenate([length[single], lengths])
    order = np.lexsort((h, length, doc))
    doc, h = doc[order], h[order]
    begin = np.searchsorted(doc, np.arange(len(ids) + 1))
    shared = np.diff(begin)
    # A document's own hashes have the shortest lists of all; the rest of its short lists are shared.
    short = np.clip(n - least_overlap(n) + 1 - (n - shared), 0, None)
    some = np.flatnonzero(short)
    out = {
        "set_id": ids[some],
        "n": n[some],
        "shared": [np.sort(h[begin[i] : begin[i + 1]]).tobytes() for i in some],
        "short": [h[begin[i] : begin[i] + short[i]].astype(np.int64).tolist() for i in some],
    }
    return pa.Table.from_batches([_arrow(out, _MEETING)])


def divide_skip(lists_of: np.ndarray, first: np.ndarray, n: np.ndarray, query: np.ndarray, against: np.ndarray, linked) -> Iterator[tuple[int, int]]:
    """Pairs (query, other) of sets with the required similarity.

    ``lists_of`` has the dense numbers of the shared hashes of each set (``first`` delimits the sets), in
    ascending order; ``n`` the full set sizes. Only ``against`` is indexed. ``linked(a, b)`` tells
    whether a pair need not be reported.
    """
    width = int(lists_of.max()) + 1 if len(lists_of) else 0
    counts = first[against + 1] - first[against]
    member = np.repeat(against, counts)
    names = lists_of[W.ranges(first[against], counts)]
    order = np.lexsort((member, names))
    names, member = names[order], member[order]
    begin = np.searchsorted(names, np.arange(width + 1))
    size, sets = np.diff(begin), len(n)
    key = names * sets + member
    for q in query.tolist():
        own = lists_of[first[q] : first[q + 1]]
        need = int(least_overlap(int(n[q])))
        # Set the longest lists aside, T / (mu log M + 1) of them, as long as the merge keeps a threshold.
        longest = own[np.argsort(-size[own], kind="stable")]
        aside = int(min(need - 1, need / (MU * np.log2(max(2, int(size[longest[0]]) if len(longest) else 2)) + 1)))
        long_, short = longest[:aside], longest[aside:]
        # The lists are ascending runs, which a stable sort finds and merges, as a heap would one by one.
        merged = np.sort(member[W.ranges(begin[short], size[short])], kind="stable")
        at = np.flatnonzero(np.diff(merged, prepend=-1))
        found, times = merged[at], np.diff(np.append(at, len(merged)))
        likely = (times >= need - aside) & (n[found] * DENOMINATOR >= n[q] * NUMERATOR) & (n[found] * NUMERATOR <= n[q] * DENOMINATOR) & (found != q)
        found, times = found[likely], times[likely]
        left = np.fromiter((not linked(q, x) for x in found.tolist()), bool, len(found))
        found, times = found[left], times[left]
        if not len(found):
            continue
        # Every candidate is looked up in every long list by binary search, a bounded number of lists at a time.
        step = max(1, PROBES // len(found))
        for k in range(0, len(long_), step):
            wanted = long_[k : k + step, None] * sets + found[None, :]
            times = times + (key[np.minimum(np.searchsorted(key, wanted), len(key) - 1)] == wanted).sum(axis=0)
        similar = times * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (n[q] + n[found])
        for x in found[similar].tolist():
            if not linked(q, x):
                yield q, x


def _search_blocks(rows: pa.Table) -> pa.Table:
    """Links that connect the similar sets of one task: neighbourhoods whole, or one pair of blocks of a large one."""
    raw, n = rows.column("shared").to_pylist(), rows.column("n").to_numpy()
    ids, side, area = rows.column("set_id").to_numpy(), rows.column("side").to_numpy(), rows.column("area").to_numpy()
    order = np.lexsort((ids, n, area))
    ids, n, side, area = ids[order], n[order], side[order], area[order]
    parts = [np.frombuffer(raw[i], np.uint64) for i in order]
    a, b = [], []
    edges = np.flatnonzero(np.concatenate([[True], area[1:] != area[:-1], [True]]))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        sizes = np.fromiter(map(len, parts[lo:hi]), np.int64, hi - lo)
        _, dense = np.unique(np.concatenate(parts[lo:hi]), return_inverse=True)
        first = np.concatenate([[0], np.cumsum(sizes)])
        root = list(range(hi - lo))

        def top(i: int, root=root) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        own = side[lo:hi]
        query, against = (np.flatnonzero(own == 0), np.flatnonzero(own == 1)) if (own == 1).any() else (np.arange(hi - lo),) * 2
        for q, x in divide_skip(dense, first, n[lo:hi], query, against, lambda i, j: top(i) == top(j)):
            root[top(q)] = top(x)
            a.append(int(ids[lo + q]))
            b.append(int(ids[lo + x]))
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def similar_links(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Links ``a, b`` between set ids that connect all documents of Jaccard similarity 0.8 or more."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(LEAST_SHARDS.bit_length() - 1, (total // SHARD_BYTES).bit_length())
    shared = texts.mapInArrow(_index_rows(buckets), _INDEX).groupBy("bucket").applyInArrow(_merge_lists, _SHARED)
    # The same set may come from several batches.
    meeting = written(shared.groupBy("batch").applyInArrow(_short_lists, _MEETING))
    lists = meeting.select("set_id", F.explode("short").alias("list"))
    met = lists.groupBy("list").agg(F.min("set_id").alias("least"), F.max("set_id").alias("most")).where("least < most")
    # Sets that meet in a list are neighbours: each is tied to the list's first set.
    ties = lists.join(met, "list").select(F.col("set_id").alias("a"), F.col("least").alias("b"))
    areas = min_label(ties).select(F.col("node").alias("set_id"), F.col("label").alias("area"))
    sets = meeting.groupBy("set_id").agg(F.first("n").alias("n"), F.first("shared").alias("shared")).join(areas, "set_id")
    sets = written(sets)
    bytes_ = sets.groupBy("area").agg(F.sum(F.length("shared") + 64).alias("bytes"))
    placed = sets.join(bytes_.select("area", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int").alias("blocks")), "area")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    # A neighbourhood of one block is searched whole; of a larger one, every pair of blocks (i <= j) is a task.
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(
            F.least(other, F.col("block")).alias("i"),
            F.greatest(other, F.col("block")).alias("j"),
            F.when(other < F.col("block"), 1).otherwise(0).alias("side"),
        ),
    )
    tasks = placed.withColumn("p", F.explode(pairs))
    small = F.pmod(F.xxhash64("area"), F.lit(buckets))
    key = F.when(F.col("blocks") == 1, F.struct(small.alias("x"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))).otherwise(F.struct(F.col("area").alias("x"), F.col("p.i").alias("i"), F.col("p.j").alias("j")))
    tasks = tasks.select(key.alias("task"), "area", "set_id", "n", "shared", F.col("p.side").alias("side"))
    return tasks.groupBy("task").applyInArrow(_search_blocks, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, set_id`` of every row.

    Words are runs of anything but space and the characters 09 to 0D, A to Z lower-cased; a document's
    set has its distinct 5-word shingles, or its whole sequence if it has fewer words. Documents link from
    a Jaccard similarity of 0.8 on; ``component_id`` is the smallest doc_id that links reach. Null texts
    and texts without words have an empty set and link with nothing. A null id never is a component's
    name unless all its rows have one; repeated rows each get their row. An empty table gives an empty result.
    A text of any length is one set, built by one task from the whole text; a similarity of exactly 0.8 links. Other
    columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sets = written(rows.mapInArrow(_set_rows, "doc_id long, n_shingles long, set_id long"))
    labels = min_label(written(similar_links(docs, text_col)))
    ids = sets.where("set_id <> 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    classes = ids.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    names = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    named = written(classes.join(names, "label").select("set_id", "component_id"))
    out = sets.where("set_id <> 0").join(named, "set_id").select("doc_id", "n_shingles", "component_id", "set_id")
    return out.union(sets.where("set_id = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "set_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest id of each component, with the columns of ``docs``; rows of a repeated id stay together."""
    found = jaccard_components(docs, id_col, text_col)
    dropped = found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(dropped, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
