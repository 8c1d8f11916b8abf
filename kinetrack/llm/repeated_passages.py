"""Substring deduplication with compact windows.

The tokens of a document are its 5-word shingles. For a hash function f and a token c, the compact
window (l, c, r) covers all passages between l and r that contain c and have c as their min-hash: it is
c's subtree in the Cartesian tree of the tokens' hashes. Two passages share a min-hash exactly if they
lie in windows with the same centre value, so documents are joined on centres:

1. The values are hashes of ``CONTEXT`` tokens in a row, one for each token, under one hash function. Two passages
   that count and repeat no token or phrase of their own share ``certain_run`` tokens in a row: 21, if 46 are the fewest.
   Windows of as many values as such a run has (10) are taken, so both documents have a centre in the run, and with
   the same value; this does not depend on luck.
2. A centre whose value stands at two places or more is marked, and all runs of 21 tokens around it become keys. The
   postings of a key say which tokens stand before and after it. Holders of the same ``least`` tokens are joined with
   the first of them, which needs no proof, and those of the same 41 distinct tokens too, which count whatever stands
   around them, but are verified. All others are paired, but only where their common run begins: the pairs are those
   of different texts that share 21 to 40 tokens. Rows with the same surroundings are paired once. Of a run with more than
   ``FEW`` holders those stay that passages found so far do not tie into one class there. Each class is tried with the
   run's largest first; then holders of different classes are candidates if the tokens around the run let them count:
   a span of ``least`` tokens whose tokens, but for a fifth, stand around the other's run too.
   Runs of one to three tokens that repeat at once are paired at their end only.
3. Shared windows on one diagonal of two documents that overlap make one passage. The other centres of a
   diagonal make one candidate, unless passages found before hold the centre in both documents and tie these into one class: first
   shared windows, then what one candidate for each place of a document has given.
   It is verified on the tokens themselves: from each centre the passage grows
   while it pays, and it counts if the token sets have a Jaccard similarity of ``0.8`` and both sides have
   ``least`` tokens. If what has grown does not count, all spans around the centre with the same bounds on
   both sides are tried, up to twice ``least`` tokens: of a longer one that counts, one half does so too.

Exact repeats of ``least`` tokens are all found. Near passages are found if they share 21 tokens in a row; only
passages that repeat their own tokens or phrases can count without such a run. Spans that count only with
different bounds on both sides may fail verification. The holders of one key are compared by one task, which holds
the tokens around them; candidates are only those that their tokens do not rule out, but where many holders of a run
are nearly alike without being tied, those still grow with the square of their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .packed import pack, pack_sorted, unpack, unpack_sorted
from .tables import min_label, numbered, written

K = 5
#: Words of the shortest passage; tokens of context that make a value.
LEAST_WORDS, CONTEXT = 50, 12
#: Bits that mark keys of two places by their upper bits; more keys than bits only mean that more places are looked at.
HOT_BITS = 27
NUMERATOR, DENOMINATOR = 80, 100
SHARD_BYTES, BATCH_TOKENS, LEAST_SHARDS = 4 << 20, 1 << 20, 64
#: Holders of one run of which all pairs are made at once; more are listed one by one.
FEW = 16
#: Bits that mark documents whose tokens are wanted; more documents than bits only mean that more texts are joined.
WANTED_BITS = 24
#: Pairs of holders whose tokens are compared at once.
PAIRS_AT_ONCE = 1 << 10


def _minima(values: np.ndarray, levels: int) -> list[np.ndarray]:
    """spans[k][i]: the minimum of 2 ** k values from i on, for up to ``levels`` k."""
    spans = [values]
    while len(spans) < levels and 1 << len(spans) <= len(values):
        a = spans[-1]
        spans.append(np.minimum(a[: len(values) - (1 << len(spans)) + 1], a[1 << (len(spans) - 1) :][: len(values) - (1 << len(spans)) + 1]))
    return spans


def centres(values: np.ndarray, least: int) -> np.ndarray:
    """The centres of all compact windows of at least ``least`` values: the first minimum of each ``least`` values in a row.

    A value 0 separates documents.
    """
    n = len(values)
    if n < least:
        return np.zeros(0, np.int64)
    k = least.bit_length() - 1
    spans = _minima(values, k + 1)
    low = np.minimum(spans[k][: n - least + 1], spans[k][least - (1 << k) :][: n - least + 1])
    inside = np.flatnonzero(low > 0)
    near = np.zeros(n, bool)
    # The position of each window's first minimum.
    step = inside.copy()
    rest = low[inside]
    for j in reversed(range(k + 1)):
        width = 1 << j
        fits = step + width <= n
        skip = fits & (spans[j][np.minimum(step, len(spans[j]) - 1)] > rest)
        step = np.where(skip, step + width, step)
    near[np.minimum(step, n - 1)] = len(inside) > 0
    return np.flatnonzero(near)


def compact_windows(values: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r), r included, of the Cartesian tree nodes that cover at least ``least`` values.

    A value 0 separates documents. Of equal values the first counts as the smaller one.
    """
    n = len(values)
    c = centres(values, least)
    spans = _minima(values, n.bit_length())
    own = values[c]
    left, right = c.copy(), c.copy()  # the window so far
    for j in reversed(range(len(spans))):
        width, s = 1 << j, spans[j]
        start = left - width
        ok = (start >= 0) & (s[np.clip(start, 0, len(s) - 1)] > own)
        left = np.where(ok, start, left)
        start = right + 1
        ok = (start + width <= n) & (s[np.clip(start, 0, len(s) - 1)] >= own)
        right = np.where(ok, right + width, right)
    keep = right - left + 1 >= least
    return left[keep], c[keep], right[keep]


def document_tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, W.Words]]:
    """For consecutive rows: (first, last, token hashes, first token of each document and the end, words)."""
    for a, b, data, offsets in W.raw_chunks(texts):
        w = W.split(data, offsets, W.SPACED)
        h, first = W.shingles(w, K)
        yield a, b, h, first, w


def certain_run(least: int) -> int:
    """Tokens in a row that two passages which count surely share, if neither repeats a token or phrase.

    Of ``s`` shared tokens in ``r`` runs, each of the ``r - 1`` breaks costs both sides ``K - 1`` tokens at least.
    """
    fewest, loss = _proof(least), NUMERATOR * 2 * (K - 1) // (DENOMINATOR - NUMERATOR)
    return min(-(-s // (s // loss + 1)) for s in range(fewest, fewest + 2 * loss))


def _proof(least: int) -> int:
    """Distinct tokens in a row that make two passages of ``least`` tokens count, whatever stands around them."""
    return -(-2 * least * NUMERATOR // (NUMERATOR + DENOMINATOR))


def _sums(h: np.ndarray) -> np.ndarray:
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * W._power(W._BASE, len(h))[: len(h)], out=total[1:])
    return total


def _hashes(total: np.ndarray, at: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """Hashes of the ``n`` tokens from each place on, from the sums of all tokens."""
    return W.mix((total[at + n] - total[at]) * W._power(W._INVERSE, len(total))[at])


def _contexts(h: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sums of the tokens, the value of the context that begins at each token (0: none), the centres of its windows, and their width."""
    run = certain_run(least)
    context = min(CONTEXT, run)
    total, values = _sums(h), np.zeros(len(h), np.uint64)
    whole = np.flatnonzero(np.arange(len(h)) + context <= np.repeat(first[1:], np.diff(first)))
    values[whole] = _hashes(total, whole, context) | np.uint64(1)
    return total, values, centres(values, run - context + 1), run - context + 1


def _keys(least: int):
    def found(h: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        _, values, c, _ = _contexts(h, first, least)
        return {"key": W.mix(values[c])}

    return found


#: Bits of a key: the place is one of those whose windows are listed inside a run, and the tokens there repeat at once.
LISTED, FLAT = np.uint64(1), np.uint64(2)


def _windows(least: int, hot: np.ndarray):
    """The runs of ``certain_run`` tokens around the centres whose key is marked, with what stands around them."""
    run, proof = certain_run(least), _proof(least)
    reach = 2 * least - 2

    def found(h: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        total, values, c, width = _contexts(h, first, least)
        at = (W.mix(values[c]) >> np.uint64(64 - HOT_BITS)).astype(np.int64)
        c = c[(hot[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)]
        doc = np.searchsorted(first, c, side="right") - 1
        low = np.maximum(first[doc], c - width + 1)
        spots = np.unique(W.ranges(low, np.maximum(0, np.minimum(c, first[doc + 1] - run) - low + 1)))
        doc = np.searchsorted(first, spots, side="right") - 1
        begin, end = first[doc], first[doc + 1]
        listed = np.ones(len(spots), bool)
        for j in range(1, width):
            listed &= values[spots] <= values[spots + j]
        flat = np.zeros(len(h) + 1, bool)
        for d in range(1, min(4, run)):
            same = np.concatenate([[0], np.cumsum(h[:-d] == h[d:]), np.zeros(d, np.int64)])
            n = max(0, len(h) - run + 1)
            flat[:n] |= same[run - d : run - d + n] - same[:n] == run - d
        # The place before each token where it stood last, and the last such place of all tokens so far.
        order = np.argsort(h, kind="stable")
        again = np.flatnonzero(h[order[1:]] == h[order[:-1]])
        last = np.full(len(h), -1)
        last[order[again + 1]] = order[again]
        last = np.maximum.accumulate(last)

        def within(n: int, where: np.ndarray) -> np.ndarray:
            out = np.zeros(len(spots), np.uint32)
            out[where] = (_hashes(total, spots[where], n) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            return out

        whole = within(least, spots + least <= end)
        fits = (spots + proof <= end) & (end - begin >= least)
        distinct = fits & (last[np.minimum(spots + proof, len(h)) - 1] < spots)
        near = np.where(distinct, within(proof, distinct), whole)
        before, after = np.minimum(spots - begin, reach), np.minimum(end - 1 - spots, run - 1 + reach)
        # No run goes on to the left of a document's begin, nor, as far as links go, into tokens that repeat at once.
        opens = (spots == begin) | (flat[np.maximum(spots - 1, 0)] & ~flat[spots])
        token = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        after_it = (token[np.minimum(spots + least, len(h) - 1)] >> np.uint32(8)).astype(np.uint8) | np.uint8(1)
        around = W.mix(_hashes(total, spots - before, before + after + 1) + (before * 1024 + after).astype(np.uint64))
        key = _hashes(total, spots, run) & ~(LISTED | FLAT) | listed * LISTED | flat[spots] * FLAT
        return {"key": key, "doc": doc, "place": spots - begin, "before": before, "after": after, "prev": np.where(opens, np.uint32(0), token[np.maximum(spots - 1, 0)]), "next": np.where(spots + least < end, after_it, np.uint8(0)), "near": near, "whole": whole, "around": (around >> np.uint64(32)).astype(np.uint32)}

    return found


_PAIRS = "x long, y long, diagonal long, start long, stop long, centre long"
_FIELDS = {"rid": np.int64, "place": np.uint32, "before": np.uint16, "after": np.uint16, "prev": np.uint32, "next": np.uint8, "near": np.uint32, "whole": np.uint32, "around": np.uint32}
_MARKS = "bucket long, keys binary"
_INDEX = "bucket long, keys binary, " + ", ".join(f"{c} binary" for c in _FIELDS) + ", pairs binary"


def _rows_of_pairs(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, least: int, whole: bool) -> np.ndarray:
    """Pairs of postings as rows of ``_PAIRS``: a window that both have, with centre -1, or a region with a centre to be verified."""
    other = p["rid"][x] != p["rid"][y]
    x, y = x[other], y[other]
    swap = p["rid"][x] < p["rid"][y]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    cx, cy = p["place"][x].astype(np.int64), p["place"][y].astype(np.int64)
    if whole:
        start, stop, centre = cx, cx + least - 1, np.full(len(x), -1)
    else:
        # A span with enough of the run in it contains this token of the run.
        start, stop, centre = cx - np.minimum(p["before"][x], p["before"][y]), cx + np.minimum(p["after"][x], p["after"][y]), cx + certain_run(least) - 1
    found = np.stack([p["rid"][x], p["rid"][y], cx - cy, start, stop, centre], axis=1)
    if not len(found):
        return found
    found = found[np.lexsort(found.T[::-1])]
    return found[np.concatenate([[True], (found[1:] != found[:-1]).any(axis=1)])]


def _sorted(p: dict[str, np.ndarray], *by: str) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Postings by ``by``, then rid and place; the first and last of each one's group, and the first of each group."""
    order = np.lexsort((p["place"], p["rid"], *(p[c] for c in reversed(by))))
    p = {c: v[order] for c, v in p.items()}
    begins = np.ones(len(order), bool)
    begins[1:] = False
    for c in by:
        begins[1:] |= p[c][1:] != p[c][:-1]
    first = np.flatnonzero(begins)
    size = np.diff(np.append(first, len(order)))
    return p, np.repeat(first, size), np.repeat(first + size - 1, size), first


def _differ(v: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether two postings differ in a value; 0 differs from all."""
    return (v[x] != v[y]) | (v[x] == 0)


def _tied(p: dict[str, np.ndarray], head: np.ndarray, tail: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that postings share with the first one of their group (those of its document with the last one), and the partners.

    Inside a run that two documents share only windows at listed places are given, and those where the run begins and ends.
    """
    x = np.arange(len(head))
    y = np.where(p["rid"] == p["rid"][head], tail, head)
    wanted = ~_differ(p["whole"], x, y) & (_differ(p["prev"], x, y) | _differ(p["next"], x, y) | ((p["key"] & LISTED) > 0))
    return _rows_of_pairs(p, x[wanted], y[wanted], least, True), y


def _gathered(p: dict[str, np.ndarray], least: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Postings of one batch that go on to other batches, by key, and pairs: one posting stands for all with the same surroundings."""
    p, head, tail, _ = _sorted(p, "key", "around")
    pairs, _ = _tied(p, head, tail, least)
    onward = (p["rid"] == p["rid"][head]) | (np.arange(len(head)) == tail)
    return {c: v[onward] for c, v in p.items()}, pairs


def _joined(p: dict[str, np.ndarray], least: int) -> Iterator[np.ndarray]:
    """A bucket's postings as pairs that are to be linked or verified, and the holders of the runs that more than ``FEW`` hold."""
    p, head, tail, _ = _sorted(p, "key", "whole")
    yield _tied(p, head, tail, least)[0]
    # The same ``_proof`` tokens: a link to the first holder stands for all, but passages are verified.
    p, head, tail, _ = _sorted(p, "key", "near")
    x = np.arange(len(head))
    y = np.where(p["rid"] == p["rid"][head], tail, head)
    wanted = ~_differ(p["near"], x, y) & _differ(p["prev"], x, y) & _differ(p["whole"], x, y)
    yield _rows_of_pairs(p, x[wanted], y[wanted], least, False)
    # All others that share a run which begins here; of the same surroundings two rows are enough.
    p, head, tail, _ = _sorted(p, "key", "around")
    some = ((np.arange(len(head)) == head) | (np.arange(len(head)) == tail)) & ((p["key"] & FLAT) == 0)
    p, head, tail, first = _sorted({c: v[some] for c, v in p.items()}, "key")
    if not len(head):
        return
    x = np.arange(len(head))
    mixed = np.add.reduceat((_differ(p["prev"], x, head) & (x > head)).astype(np.int64), first) * np.add.reduceat((_differ(p["near"], x, head) & (x > head)).astype(np.int64), first)
    size = tail[first] + 1 - first
    for n in range(2, FEW + 1):
        begin = first[(mixed > 0) & (size == n)][:, None]
        i, j = np.triu_indices(n, 1)
        x, y = (begin + i).ravel(), (begin + j).ravel()
        wanted = _differ(p["prev"], x, y) & _differ(p["near"], x, y)
        yield _rows_of_pairs(p, x[wanted], y[wanted], least, False)
    yield _rows_of_holders({c: v[np.repeat((mixed > 0) & (size > FEW), size)] for c, v in p.items()})


def _rows_of_holders(p: dict[str, np.ndarray]) -> np.ndarray:
    """Postings in the columns of ``_PAIRS``: the document, the key, ``prev`` and ``near``, the region, and the place as a centre below -1."""
    place, ends = p["place"].astype(np.int64), p["prev"].astype(np.uint64) << np.uint64(32) | p["near"]
    return np.stack([p["rid"], p["key"].view(np.int64), ends.view(np.int64), place - p["before"], place + p["after"], -2 - place], axis=1)


def _index_rows(buckets: int, least: int, postings, marking: bool):
    """Postings of batches of documents by bucket: only keys, each twice at most, or all that ``_joined`` needs."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    names = [c.split()[0] for c in (_MARKS if marking else _INDEX).split(", ")]

    def flush(held: list, number: int) -> Iterator[pa.RecordBatch]:
        p = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        if marking:
            key = np.sort(p["key"])
            p, pairs = {"key": np.concatenate([key[:2], key[2:][key[2:] != key[:-2]]])}, None
        else:
            p, pairs = _gathered({"key": p["key"]} | {c: p[c].astype(t) for c, t in _FIELDS.items()}, least)
        home = int(W.mix(np.array([TaskContext.get().partitionId() * 2**20 + number], np.uint64))[0]) % buckets
        rows = []
        for k, a, b in W.buckets_of(p["key"] >> shift, home):
            row = [k, pack_sorted(p["key"][a:b])]
            if not marking:
                row += [*(pack(p[c][a:b]) for c in _FIELDS), pack(pairs.ravel()) if k == home else None]
            rows.append(row)
        columns = list(zip(*rows, strict=True))
        yield pa.record_batch([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, number = [], 0, 0
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            for a, _, h, first, _ in document_tokens(batch.column("text")):
                if not len(h):
                    continue
                found = postings(h, first)
                if not marking:
                    found["rid"] = rid[a:][found.pop("doc")]
                held.append(found)
                count += len(h)
                if count >= BATCH_TOKENS:
                    yield from flush(held, number)
                    held, count, number = [], 0, number + 1
        if count:
            yield from flush(held, number)

    return run


def _mark_keys(buckets: int):
    """A bit for each key of a bucket that stands at two places."""

    def run(rows: pa.Table) -> pa.Table:
        key = np.sort(np.concatenate([unpack_sorted(r) for r in rows.column("keys").to_pylist()]))
        marks = np.zeros(max(8, (1 << HOT_BITS) // buckets), np.uint8)
        marks[(key[:-1][key[1:] == key[:-1]] >> np.uint64(64 - HOT_BITS)).astype(np.int64) % len(marks)] = 1
        return pa.table({"bucket": rows.column("bucket")[:1], "marks": pa.array([pack(np.packbits(marks))], pa.binary())})

    return run


def _join_batches(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names = [], [c.split()[0] for c in _PAIRS.split(", ")]

        def out(pairs: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.ascontiguousarray(pairs[:, i])) for i in range(6)], names=names)

        for batch in batches:
            cells = batch.to_pydict()
            held.append({"key": np.concatenate([unpack_sorted(r) for r in cells["keys"]])} | {c: np.concatenate([unpack(r, t) for r in cells[c]]) for c, t in _FIELDS.items()})
            for r in cells["pairs"]:
                if r is not None:
                    yield out(unpack(r, np.int64).reshape(-1, 6))
        for pairs in _joined({c: np.concatenate([h[c] for h in held]) for c in held[0]}, least):
            yield out(pairs)

    return run


def _cut_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of each document from ``begin`` to ``end``, as the upper 32 bits of their hashes: enough within one pair of regions."""
    for batch in batches:
        rid, begin, end = (batch.column(c).to_pylist() for c in ("rid", "begin", "end"))
        for a, b, h, first, _ in document_tokens(batch.column("text")):
            tokens = [(h[first[i - a] + begin[i] : first[i - a] + end[i] + 1] >> np.uint64(32)).astype(np.uint32).tobytes() for i in range(a, b)]
            yield pa.record_batch([pa.array(rid[a:b], pa.int64()), pa.array(begin[a:b], pa.int64()), pa.array(tokens, pa.binary())], names=["rid", "begin", "tokens"])


def _stretches(texts: DataFrame, loose: DataFrame, held: DataFrame) -> DataFrame:
    """The tokens that candidates and holders, and all candidates made of them, can ask for (``rid, begin, tokens``), one stretch a document.

    Most documents have none: their texts are left out by a broadcast table of ``2 ** WANTED_BITS`` bits before the others are joined.
    """
    regions = loose.select(F.col("x").alias("rid"), "start", "stop").union(loose.select("y", F.col("start") - F.col("diagonal"), F.col("stop") - F.col("diagonal")))
    wanted = written(regions.union(held.select("rid", "start", "stop")).groupBy("rid").agg(F.min("start").alias("begin"), F.max("stop").alias("end")))
    at = F.shiftrightunsigned(F.xxhash64("rid"), 64 - WANTED_BITS)
    bits = wanted.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(at & 63)))").alias("bits"))
    some = texts.select("rid", "text", at.alias("at")).withColumn("word", F.shiftright("at", 6))
    some = some.join(F.broadcast(bits), "word").where("bits & shiftleft(1L, int(at & 63)) <> 0").select("rid", "text")
    return written(some.join(wanted, "rid").mapInArrow(_cut_tokens, "rid long, begin long, tokens binary"))


def _cut_regions(fields: tuple[str, ...]):
    """The wanted regions of each stretch with their tokens, a row for each; one copy of a stretch serves them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, begin = (batch.column(c).to_pylist() for c in ("rid", "begin"))
            tokens, regions = batch.column("tokens"), batch.column("regions")
            for i in range(batch.num_rows):
                wanted = regions[i].values
                columns = {c: wanted.field(c) for c in fields}
                own = tokens[i].as_py()
                cut = [own[4 * (a - begin[i]) : 4 * (b - begin[i] + 1)] for a, b in zip(columns["start"].to_pylist(), columns["stop"].to_pylist(), strict=True)]
                yield pa.record_batch([pa.array([rid[i]] * len(cut), pa.int64()), *columns.values(), pa.array(cut, pa.binary())], names=["rid", *fields, "tokens"])

    return run


def _regions(stretches: DataFrame, regions: DataFrame, *fields: str) -> DataFrame:
    """``regions`` (``rid``, ``start``, ``stop`` and other ``fields``, all long) with their tokens."""
    wanted = regions.groupBy("rid").agg(F.collect_list(F.struct(*fields)).alias("regions"))
    return stretches.join(wanted, "rid").mapInArrow(_cut_regions(fields), ", ".join(f"{c} long" for c in ("rid", *fields)) + ", tokens binary")


#: What a token that the other side lacks costs while a passage grows; a stricter one is tried if the passage fails, then all spans.
LOSSES = (4, 9, 1 << 40)


def _grow(held: np.ndarray, seed: int, loss: int) -> tuple[int, int]:
    """The passage around ``seed`` whose end pieces all pay: a token held by the other side counts 1, another ``-loss``."""
    gain = np.where(held, 1, -loss)
    right = np.cumsum(gain[seed:])
    left = np.cumsum(gain[: seed + 1][::-1])
    return seed - int(left.argmax()), seed + int(right.argmax())


def _best_span(x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray, seed: int, least: int, begin: int = 0) -> tuple[int, int] | None:
    """The span around ``seed``, of the same bounds on both sides, that counts and has the highest similarity, then length.

    It starts at ``begin`` at the earliest. Spans of less than twice ``least`` tokens are enough: half of a longer one that counts does so too, repeated tokens aside.
    """
    origin = max(0, begin, seed - 2 * least + 2)
    near = slice(origin, min(len(x), len(y), seed + 2 * least - 1))
    x, y, held_x, held_y, seed = x[near], y[near], held_x[near], held_y[near], seed - origin
    n = len(x)
    if n < least:
        return None
    # Jaccard >= 0.8 exactly if tokens in both count 1 on each side and others -8, and the sum is not negative.
    # Bounded from above first: tokens held anywhere in the region, repeats of others free.
    loss = 2 * NUMERATOR // (DENOMINATOR - NUMERATOR)
    gain = np.zeros(n, np.int64)
    for v, held in ((x, held_x), (y, held_y)):
        again = np.sort(v)
        gain += np.where(held, 1, -loss)
        if (again[1:] == again[:-1]).any():
            repeat = np.ones(n, bool)
            repeat[np.unique(v, return_index=True)[1]] = False
            gain += np.where(repeat & ~held, loss, 0)
    total = np.concatenate([[0], np.cumsum(gain)])
    top = np.maximum.accumulate(total[::-1])[::-1]  # of all ends from here on
    starts = np.arange(min(seed, n - least) + 1)
    starts = starts[top[np.maximum(seed + 1, starts + least)] >= total[starts]]
    if not len(starts):
        return None
    _, code = np.unique(np.concatenate([x, y]), return_inverse=True)
    at = np.arange(n)
    cx, cy = code[:n] * (n + 1), code[n:] * (n + 1)

    def latest(own: np.ndarray, other: np.ndarray, until: np.ndarray) -> np.ndarray:
        """The last place of each of ``own`` in ``other`` before ``until``, or -1."""
        places = np.sort(other + at)
        k = np.searchsorted(places, own + until) - 1
        found = places[np.maximum(k, 0)]
        return np.where((k >= 0) & (found >= own), found - own, -1)

    before_x, before_y, x_in_y, y_in_x = latest(cx, cx, at), latest(cy, cy, at), latest(cx, cy, at + 1), latest(cy, cx, at)
    low = int(starts[0])
    a, i = starts[:, None], at[low:]
    new_x, new_y = (before_x[low:] < a) & (i >= a), (before_y[low:] < a) & (i >= a)
    both = np.cumsum((new_x & (x_in_y[low:] >= a)).astype(np.int32) + (new_y & (y_in_x[low:] >= a)), axis=1)
    union = np.maximum(1, np.cumsum(new_x.astype(np.int32) + new_y, axis=1) - both)
    size = i - a + 1
    counts = (i >= seed) & (size >= least) & (size < 2 * least) & (both * DENOMINATOR >= NUMERATOR * union)
    if not counts.any():
        return None
    j, b = np.unravel_index(np.argmax(np.where(counts, both / union + size * 1e-9, -1.0)), counts.shape)
    return origin + int(starts[j]), origin + low + int(b)


def _compared(x: np.ndarray, y: np.ndarray, a: int, b: int, c: int, d: int) -> tuple[int, int, int, int, float] | None:
    """The two passages with their similarity, if it is high enough."""
    one, two = np.unique(x[a : b + 1]), np.unique(y[c : d + 1])
    both = len(np.intersect1d(one, two, assume_unique=True))
    union = len(one) + len(two) - both
    return (a, b, c, d, both / union) if both * DENOMINATOR >= NUMERATOR * union else None


def similar_passages(x: np.ndarray, y: np.ndarray, seeds: list[int], least: int) -> list[tuple[int, int, int, int, float]]:
    """Verified passages (start, stop in x, start, stop in y, similarity) around the seeds, ends included.

    ``x`` and ``y`` are the tokens of the aligned regions of two documents, seeds are positions in both.
    """
    if len(x) == len(y) and np.array_equal(x, y):
        return [(0, len(x) - 1, 0, len(y) - 1, 1.0)] if len(x) >= least else []
    own_x, own_y = np.unique(x), np.unique(y)
    shared = np.intersect1d(own_x, own_y, assume_unique=True)
    # A span has ``least`` distinct tokens at least, but for repeats, and shares the wanted part of them.
    fewest = least - min(len(x) - len(own_x), len(y) - len(own_y))
    if len(shared) * DENOMINATOR < NUMERATOR * fewest:
        return []
    held_x, held_y = (shared[np.minimum(np.searchsorted(shared, v), len(shared) - 1)] == v for v in (x, y))
    out, done, tried = [], -1, -1
    for s in sorted(seeds):
        if s <= done or s >= len(x) or s >= len(y):
            continue
        best = None
        for loss in LOSSES:
            a, b = _grow(held_x, s, loss)
            c, d = _grow(held_y, s, loss)
            if b - a + 1 < least or d - c + 1 < least:
                break  # a stricter loss gives no longer passage
            if best := _compared(x, y, a, b, c, d):
                break
        # Spans that contain the seed before were tried with it.
        if not best and (span := _best_span(x, y, held_x, held_y, s, least, tried + 1)):
            best = _compared(x, y, *span, *span)
        if best:
            out.append(best)
            done = best[1]
        else:
            tried = s
    return out


_FOUND = "x long, y long, x_start long, x_words long, y_start long, y_words long, similarity double"


def _verify(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                x, y = np.frombuffer(r["x_tokens"], np.uint32), np.frombuffer(r["y_tokens"], np.uint32)
                shift = r["start"] - r["diagonal"]
                for a, b, c, d, s in similar_passages(x, y, [v - r["start"] for v in r["centres"]], least):
                    rows.append((r["x"], r["y"], r["start"] + a, b - a + K, shift + c, d - c + K, s))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            names = [c.split()[0] for c in _FOUND.split(", ")]
            yield pa.record_batch([pa.array(c, pa.float64() if n == "similarity" else pa.int64()) for c, n in zip(cols, names, strict=True)], names=names)

    return run


def _spans(found: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Where found passages, and the spans of those found before, stand in each document, with the class that they tie it into (``rid, begin, end, label``)."""
    spans = found.select(F.col("x").alias("rid"), F.col("x_start").alias("run_start"), (F.col("x_start") + F.col("x_words") - K + 1).alias("run_stop"))
    spans = spans.union(found.select("y", "y_start", F.col("y_start") + F.col("y_words") - K + 1))
    ties = found.select(F.col("x").alias("a"), F.col("y").alias("b"))
    if before is not None:
        spans, ties = spans.union(before.select("rid", "begin", "end")), ties.union(before.select("rid", "label"))
    by_start = Window.partitionBy("rid").orderBy("run_start", "run_stop")
    apart = F.coalesce((F.col("run_start") > F.max("run_stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1))).cast("long"), F.lit(1))
    spans = spans.distinct().withColumn("apart", apart).withColumn("part", F.sum("apart").over(by_start)).groupBy("rid", "part").agg(F.min("run_start").alias("begin"), F.max("run_stop").alias("end"))
    labels = min_label(ties).withColumnRenamed("node", "rid")
    return written(spans.join(labels, "rid").select("rid", "begin", "end", "label"))


def _not_tied(loose: DataFrame, spans: DataFrame) -> DataFrame:
    """The candidates but those whose centre stands in found passages on both sides, of documents that such passages tie into one class."""
    for side, at in (("x", F.col("centre")), ("y", F.col("centre") - F.col("diagonal"))):
        own = spans.select(F.col("rid").alias(f"{side}_rid"), F.col("begin").alias(f"{side}_begin"), F.col("end").alias(f"{side}_end"), F.col("label").alias(f"{side}_label"))
        loose = loose.join(own, (F.col(side) == F.col(f"{side}_rid")) & (at >= F.col(f"{side}_begin")) & (at < F.col(f"{side}_end")), "left")
    return loose.where("coalesce(x_label <> y_label, true)").select("x", "y", "diagonal", "start", "stop", "centre")


_HOLDER = ("key", "rid", "place", "start", "stop", "ends")


def _not_tied_holders(holders: DataFrame, spans: DataFrame, least: int) -> DataFrame:
    """The holders of runs whose holders are not all tied into one class by found passages that hold the run, with their class (else an own one)."""
    own, at = spans.withColumnRenamed("rid", "own_rid"), F.col("place") + certain_run(least) - 1
    named = holders.select(*_HOLDER).join(own, (F.col("rid") == F.col("own_rid")) & (at >= F.col("begin")) & (at < F.col("end")), "left")
    named = written(named.select(*_HOLDER, F.coalesce("label", -1 - F.col("rid")).alias("label")))
    several = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return written(named.join(several.select("key"), "key", "left_semi"))


def _pairs_of(both: DataFrame, least: int) -> DataFrame:
    """Holders ``a`` and ``b`` of a run that begins there, as candidates (rows of ``_PAIRS``)."""
    prev, near = (lambda c: F.shiftrightunsigned(c, 32)), (lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    wanted = [(f("a.ends") == 0) | (f("a.ends") != f("b.ends")) for f in (prev, near)]
    both = both.where((F.col("a.rid") != F.col("b.rid")) & wanted[0] & wanted[1])
    first = F.col("a.rid") > F.col("b.rid")
    both = both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("p"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("q"))
    before = F.least(F.col("p.place") - F.col("p.start"), F.col("q.place") - F.col("q.start"))
    after = F.least(F.col("p.stop") - F.col("p.place"), F.col("q.stop") - F.col("q.place"))
    at = F.col("p.place")
    return both.select(F.col("p.rid").alias("x"), F.col("q.rid").alias("y"), (at - F.col("q.place")).alias("diagonal"), (at - before).alias("start"), (at + after).alias("stop"), (at + certain_run(least) - 1).alias("centre")).distinct()


def _stars(held: DataFrame, least: int) -> DataFrame:
    """One holder of each class with one of the run's largest class, if that has two holders at least."""
    classes = held.groupBy("key", "label").agg(F.min(F.struct(*_HOLDER[1:])).alias("b"), F.count("*").alias("n"))
    largest = classes.groupBy("key").agg(F.max(F.struct("n", -F.col("label"), "b")).alias("m")).where("m.n > 1").select("key", F.col("m.b").alias("a"))
    return _pairs_of(classes.join(largest, "key").select("a", "b"), least)


def _may_count(held: np.ndarray, again: np.ndarray, at: np.ndarray, plain: np.ndarray, least: int) -> np.ndarray:
    """Whether a span of ``least`` tokens around ``at`` can count, for rows of tokens of which the other side has those ``held``.

    A token in both counts 1, another -4 (80 of 100 must be shared), and a break of shared tokens costs the other side
    ``K - 1`` tokens too, if it is ``plain``: without repeats on both sides. Tokens that come ``again`` are free.
    """
    n, loss = held.shape[1], NUMERATOR // (DENOMINATOR - NUMERATOR)
    if n < least:
        return np.zeros(len(held), bool)
    gain = np.where(held, 1, np.where(again, 0, -loss)).astype(np.int32)
    breaks = np.zeros(held.shape, bool)
    breaks[:, 1:] = held[:, :-1] & ~held[:, 1:]
    cost = loss * (K - 1)
    gain -= np.where(breaks & plain[:, None], cost, 0).astype(np.int32)
    total = np.zeros((len(held), n + 1), np.int32)
    np.cumsum(gain, axis=1, out=total[:, 1:])

    def free(rows: np.ndarray) -> np.ndarray:
        """What is given back where a span ends at each token: behind its last break the other side may have left out a few tokens."""
        few, run = rows.astype(np.int32), rows
        for d in range(1, -(-cost // (loss + 1))):
            run = run[:, 1:] & rows[:, :-d]
            few[:, d:] += run
        return np.where(plain[:, None], np.maximum(0, cost - (loss + 1) * few), 0)

    # The best of all ends from each place on; a span may begin so too, unless it begins inside a break.
    top = np.maximum.accumulate((total[:, 1:] + free(held))[:, ::-1], axis=1)[:, ::-1]
    start = total[:, :-1] - np.where(held, free(held[:, ::-1])[:, ::-1], 0)
    begin = np.arange(n - least + 1)
    end = np.maximum(begin + least, at[:, None] + 1) - 1
    return ((begin <= at[:, None]) & (np.take_along_axis(top, end, axis=1) >= start[:, : len(begin)])).any(axis=1)


def _close_ones(least: int):
    """The pairs of a run's holders of different classes that can count, by the tokens around the run."""
    run, names = certain_run(least), [c.split()[0] for c in _PAIRS.split(", ")]

    def padded(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of each holder's region, numbered from 1, in a row (0: none), and which stood before in it."""
        size = p["stop"] - p["start"] + 1
        inside = np.arange(size.max()) < size[:, None]
        rows = np.zeros(inside.shape, np.int64)
        rows[inside] = np.unique(np.concatenate([np.frombuffer(t, np.uint32) for t in p["tokens"]]), return_inverse=True)[1] + 1
        order = np.argsort(rows, axis=1, kind="stable")
        sorted_ = np.take_along_axis(rows, order, axis=1)
        again = np.zeros(rows.shape, bool)
        np.put_along_axis(again, order[:, 1:], (sorted_[:, 1:] == sorted_[:, :-1]) & (sorted_[:, 1:] > 0), axis=1)
        return rows, again

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        p = {c: table.column(c).to_numpy() for c in table.column_names if c != "tokens"}
        p["tokens"] = np.array(table.column("tokens").to_pylist(), object)
        while True:
            # Only tokens that other classes have too can be shared.
            rows, again = padded(p)
            at = p["place"] - p["start"] + run - 1
            top = int(rows.max()) + 1
            low, high = np.full(top, np.iinfo(np.int64).max), np.full(top, np.iinfo(np.int64).min)
            label = np.broadcast_to(p["label"][:, None], rows.shape)
            np.minimum.at(low, rows, label)
            np.maximum.at(high, rows, label)
            plain = ~again.any(axis=1)
            alive = _may_count((rows > 0) & (low < high)[rows], again, at, plain & plain.all(), least)
            if alive.all() or not alive.any():
                break
            p = {c: v[alive] for c, v in p.items()}
        if not alive.any():
            return
        p |= {"before": p["place"] - p["start"], "after": p["stop"] - p["place"], "prev": p["ends"].view(np.uint64) >> np.uint64(32), "near": p["ends"].view(np.uint64) & np.uint64(0xFFFFFFFF)}
        labels, count = np.unique(p["label"], return_counts=True)
        largest = p["label"] == labels[count.argmax()]
        place = np.zeros(top, np.int64)  # of each token of one holder, from 1
        for o in np.flatnonzero(~largest).tolist():
            y = np.flatnonzero((p["label"] != p["label"][o]) & (largest | (np.arange(len(rows)) > o)) & (p["rid"] != p["rid"][o]))
            x = np.full(len(y), o)
            y = y[_differ(p["prev"], x, y) & _differ(p["near"], x, y)]
            if not len(y):
                continue
            own, back = np.unique(rows[o][rows[o] > 0], return_inverse=True)
            place[own] = np.arange(1, len(own) + 1)
            for i in range(0, len(y), PAIRS_AT_ONCE):
                part = y[i : i + PAIRS_AT_ONCE]
                held = np.zeros((len(part), len(own) + 1), bool)
                held[np.arange(len(part))[:, None], place[rows[part]]] = True
                same = np.broadcast_to(again[o, : len(back)], (len(part), len(back)))
                part = part[_may_count(held[:, 1:][:, back], same, np.full(len(part), at[o]), plain[o] & plain[part], least)]
                found = _rows_of_pairs(p, np.full(len(part), o), part, least, False)
                if len(found):
                    yield pa.record_batch([pa.array(np.ascontiguousarray(found[:, j])) for j in range(6)], names=names)
            place[own] = 0

    return close


def _close(stretches: DataFrame, held: DataFrame, least: int) -> DataFrame:
    """The candidates among a run's holders of different classes: those that the tokens around the run do not rule out."""
    tokens = _regions(stretches, held, *(c for c in (*_HOLDER, "label") if c != "rid"))
    return tokens.groupBy("key").applyInArrow(_close_ones(least), _PAIRS)


def _one_partner(loose: DataFrame, least: int) -> DataFrame:
    """The candidates of one partner for each place of both documents."""
    x_place = Window.partitionBy("x", F.floor(F.col("centre") / least))
    y_place = Window.partitionBy("y", F.floor((F.col("centre") - F.col("diagonal")) / least))
    chosen = loose.withColumns({"least_y": F.min("y").over(x_place), "least_x": F.min("x").over(y_place)})
    chosen = chosen.where("y = least_y or x = least_x").select("x", "y", "diagonal").distinct()
    return loose.join(chosen, ["x", "y", "diagonal"])


def _verified(stretches: DataFrame, loose: DataFrame, least: int) -> DataFrame:
    """The passages among candidates (rows of ``_PAIRS``)."""
    candidates = loose.groupBy("x", "y", "diagonal").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.collect_set("centre").alias("centres"))
    candidates = written(candidates)
    y_start, y_stop = F.col("start") - F.col("diagonal"), F.col("stop") - F.col("diagonal")
    regions = candidates.select(F.col("x").alias("rid"), "start", "stop").union(candidates.select("y", y_start, y_stop)).distinct()
    tokens = written(_regions(stretches, regions, "start", "stop"))
    x = tokens.select(F.col("rid").alias("x"), "start", "stop", F.col("tokens").alias("x_tokens"))
    y = tokens.select(F.col("rid").alias("y"), F.col("start").alias("y_start"), F.col("stop").alias("y_stop"), F.col("tokens").alias("y_tokens"))
    both = candidates.withColumns({"y_start": y_start, "y_stop": y_stop}).join(x, ["x", "start", "stop"]).join(y, ["y", "y_start", "y_stop"])
    return both.select("x", "y", "start", "diagonal", "centres", "x_tokens", "y_tokens").mapInArrow(_verify(least), _FOUND)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """Passages of ``least_words`` words or more that stand in more than one row.

    One row per passage and partner: ``doc_id, start_word, n_words, partner_id, partner_start,
    partner_words, similarity, keeps`` (whether this is the side that a deduplication keeps),
    ``class_id`` (the smallest doc_id that shared passages reach) and ``rid``. Passages are tied to the
    first or last holder of their text, both sides are listed; holders between them have the same class.
    Words are runs of anything but space and 09 to 0D, A to Z lower-cased. Null, empty and short texts
    have no passages; repeated rows are each other's partners, ties go to the smaller row number, and other columns are
    not read. Texts of any length are read whole. An empty table gives an empty result.
    """
    return _listed(numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "rid"), least_words)


def _listed(texts: DataFrame, least_words: int) -> DataFrame:
    """The passages of ``texts`` (``rid, doc_id, text``)."""
    least = least_words - K + 1
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(LEAST_SHARDS.bit_length() - 1, (total // SHARD_BYTES).bit_length())
    rows = texts.select("rid", "text")

    shared = written(rows.mapInArrow(_index_rows(buckets, least, _keys(least), True), _MARKS).groupBy("bucket").applyInArrow(_mark_keys(buckets), "bucket long, marks binary"))
    marks = np.zeros(1 << HOT_BITS >> 3, np.uint8)
    for r in shared.toLocalIterator():  # a bit for each of 2 ** HOT_BITS
        part = unpack(bytes(r["marks"]), np.uint8)
        k = r["bucket"] * (1 << HOT_BITS) // buckets >> 3
        marks[k : k + len(part)] |= part
    hot = texts.sparkSession.sparkContext.broadcast(marks)
    postings = rows.mapInArrow(_index_rows(buckets, least, lambda h, at: _windows(least, hot.value)(h, at), False), _INDEX)
    pairs = written(postings.groupBy("bucket").applyInArrow(_join_batches(least), _PAIRS))
    # Shared windows that overlap on one diagonal are one passage.
    diagonal = Window.partitionBy("x", "y", "diagonal").orderBy("start")
    apart = F.coalesce((F.col("start") > F.lag("start").over(diagonal) + least).cast("long"), F.lit(1))
    runs = pairs.where("centre = -1").select("x", "y", "diagonal", "start").withColumn("apart", apart).withColumn("run", F.sum("apart").over(diagonal))
    runs = written(runs.groupBy("x", "y", "diagonal", "run").agg(F.min("start").alias("run_start"), (F.max("start") + least).alias("run_stop")).drop("run"))
    inside = [pairs[c] == runs[c] for c in ("x", "y", "diagonal")] + [pairs["centre"] >= runs["run_start"], pairs["centre"] < runs["run_stop"]]
    shared = runs.select("x", "y", F.col("run_start").alias("x_start"), (F.col("run_stop") - F.col("run_start") + K - 1).alias("x_words"), (F.col("run_start") - F.col("diagonal")).alias("y_start"), (F.col("run_stop") - F.col("run_start") + K - 1).alias("y_words"), F.lit(1.0).alias("similarity"))
    spans = _spans(shared)
    loose = written(_not_tied(pairs.where("centre >= 0").join(runs, inside, "left_anti"), spans))
    holders = pairs.where("centre < -1").select(F.col("y").alias("key"), F.col("x").alias("rid"), (-2 - F.col("centre")).alias("place"), "start", "stop", F.col("diagonal").alias("ends"))
    held = _not_tied_holders(holders, spans, least)
    stretches = _stretches(texts, loose, held)
    # One partner for each place and class first: what that ties need not be verified again.
    chosen = written(_one_partner(loose, least))
    found = [shared, written(_verified(stretches, chosen.union(_stars(held, least)), least))]
    spans = _spans(found[-1], spans)
    rest = _not_tied(loose.join(chosen.select("x", "y", "diagonal").distinct(), ["x", "y", "diagonal"], "left_anti"), spans)
    close = written(_close(stretches, _not_tied_holders(held, spans, least), least))
    chosen = written(_one_partner(close, least))
    found.append(written(_verified(stretches, chosen.union(rest), least)))
    rest = close.join(chosen.select("x", "y", "diagonal").distinct(), ["x", "y", "diagonal"], "left_anti")
    if not rest.isEmpty():
        found.append(written(_verified(stretches, _not_tied(rest, _spans(found[-1], spans)), least)))
    found = reduce(DataFrame.union, found).distinct()
    ids = texts.select("rid", "doc_id")
    labels = min_label(found.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("node", "rid")
    named = labels.join(ids, "rid")
    classes = written(named.join(named.groupBy("label").agg(F.min("doc_id").alias("class_id")), "label").select("rid", "doc_id", "class_id"))
    # The row read first keeps a passage; each distinct passage of it is listed with one partner.
    later = found.select(F.col("x").alias("rid"), F.col("x_start").alias("start_word"), F.col("x_words").alias("n_words"), F.col("y").alias("other"), F.col("y_start").alias("partner_start"), F.col("y_words").alias("partner_words"), "similarity", F.lit(False).alias("keeps"))
    chosen = F.max_by(F.struct("x", "x_start", "x_words", "similarity"), F.struct("similarity", -F.col("x"), -F.col("x_start"))).alias("m")
    earlier = found.groupBy(F.col("y").alias("rid"), F.col("y_start").alias("start_word"), F.col("y_words").alias("n_words")).agg(chosen)
    earlier = earlier.select("rid", "start_word", "n_words", F.col("m.x").alias("other"), F.col("m.x_start").alias("partner_start"), F.col("m.x_words").alias("partner_words"), F.col("m.similarity").alias("similarity"), F.lit(True).alias("keeps"))
    partners = classes.select(F.col("rid").alias("other"), F.col("doc_id").alias("partner_id"))
    listed = later.union(earlier).join(classes, "rid").join(partners, "other")
    return listed.select("doc_id", "start_word", "n_words", "partner_id", "partner_start", "partner_words", "similarity", "keeps", "class_id", "rid")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with every repeated passage cut out of all rows but the first that holds it.

    The words of a cut passage and the white space after each of them go; null texts stay null, and other
    columns keep their values, whatever their names.
    """
    rows = numbered(docs, "__rid")
    texts = rows.select(F.col("__rid").alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = _listed(texts, least_words).where("not keeps")
    spans = written(spans.groupBy(F.col("rid").alias("__rid")).agg(F.collect_list(F.struct("start_word", "n_words")).alias("__cut")))
    rows = rows.join(spans, "__rid", "left").drop("__rid")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(text_col).to_pylist(), batch.column("__cut").to_pylist()
            for a, b, data, offsets in W.raw_chunks(batch.column(text_col)):
                w = W.split(data, offsets, W.SPACED)
                for i in range(a, b):
                    if spans[i]:
                        edge = np.append(w.start[w.first[i - a] : w.first[i - a + 1]], offsets[i - a + 1])
                        keep = np.ones(offsets[i - a + 1] - offsets[i - a], bool)
                        for s in spans[i]:
                            keep[edge[s["start_word"]] - offsets[i - a] : edge[s["start_word"] + s["n_words"]] - offsets[i - a]] = False
                        texts[i] = data[offsets[i - a] : offsets[i - a + 1]][keep].tobytes().decode()
            out = batch.set_column(batch.schema.get_field_index(text_col), text_col, pa.array(texts, pa.string()))
            yield out.drop_columns(["__cut"])

    return rows.mapInArrow(cut, docs.schema)
