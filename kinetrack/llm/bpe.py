"""Byte-level BPE encoding with a lexicon of the corpus's frequent words, and decoding.

Texts are cut at places that are token boundaries whatever stands around them (see ``tokens``). The pieces of all
documents are counted, the frequent ones are encoded once and compiled into a transducer (see ``lexicon``), which
each executor maps into memory. All pieces of a chunk of text walk through it together. What it does not hold goes
through the library's pre-tokenizer and is merged here, pair by pair, by the ranks of the tokenizer file; a worker
remembers a bounded number of such pieces. The lexicon decides how fast a piece is found, never what its ids are.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import words as W
from .lexicon import Lexicon, compile_lexicon, mapped_lexicon, spread
from .tables import text_or_empty, written
from .tokens import piece_starts, tokenizer

#: Most words of the lexicon, and bytes of the longest one.
WORDS, LONGEST = 65_536, 48
#: Pieces outside the lexicon that a worker remembers; distinct pieces that a task counts before it passes them on.
REMEMBER, HELD = 1 << 18, 1 << 18
#: The rank of pairs that never merge.
NEVER = np.iinfo(np.int32).max
#: Pieces that the pre-tokenizer leaves whole: letters, digits or signs, with a space before them or not.
PLAIN = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")


def byte_signs() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next one from 0100 on."""
    plain = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class Merger:
    """Ids of single pieces by the merges of a tokenizer file, and the bytes of ids."""

    def __init__(self, path: str):
        self.library = tokenizer(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, signs = spec["model"], byte_signs()
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) or not set(signs) <= set(model["vocab"]):
            raise ValueError("only plain byte-level BPE models with all bytes in the vocabulary are supported")
        vocab = model["vocab"]
        self.one = {s: vocab[s] for s in signs}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(pairs)}
        # The merges as sorted keys of pairs, for many pieces at once.
        keys = np.array([a << 32 | b for a, b in self.rank], np.int64)
        ranks = np.array(list(self.rank.values()), np.int64).reshape(-1, 2)
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(ranks[order, 0], NEVER).astype(np.int32)
        self.made = np.zeros(len(keys) + 1, np.int64)
        self.made[ranks[:, 0]] = ranks[:, 1]
        self.of_byte = np.array([self.one[s] for s in signs], np.int64)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        to_byte = {s: b for b, s in enumerate(signs)}
        every = {i: s for s, i in vocab.items()} | {i: s for s, i in self.added.items()}
        size = max(every) + 1
        spelled = [bytes(to_byte[c] for c in s) if all(c in to_byte for c in s) else s.encode() for s in (every.get(i, "") for i in range(size))]
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.first = np.concatenate([[0], np.cumsum([len(s) for s in spelled])])
        self.words: dict[str, list[int]] = {}
        self.pieces: dict[bytes, list[int]] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merge of the lowest rank, the leftmost first, until none applies."""
        if len(ids) > 64:
            return self._merge_long(ids)
        while len(ids) > 1:
            found = [self.rank.get(p, (1 << 30, 0)) for p in zip(ids, ids[1:])]  # noqa: B905
            best = min(found)
            if best[0] == 1 << 30:
                break
            k = found.index(best)
            ids[k : k + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same over a heap of pairs and a linked list of what is left."""
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(self.rank[p][0], k, p) for k, p in enumerate(zip(ids, ids[1:])) if p in self.rank]  # noqa: B905
        heapq.heapify(heap)
        while heap:
            _, k, pair = heapq.heappop(heap)
            j = after[k]
            if j < 0 or (ids[k], ids[j]) != pair:
                continue
            ids[k], ids[j] = self.rank[pair][1], -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (p := (ids[a], ids[b])) in self.rank:
                    heapq.heappush(heap, (self.rank[p][0], a, p))
        return [i for i in ids if i >= 0]

    def encode(self, piece: str) -> list[int]:
        out: list[int] = []
        for part in self.split.split(piece) if self.split else [piece]:
            if part in self.added:
                out.append(self.added[part])
                continue
            for word, _ in self.library.pre_tokenizer.pre_tokenize_str(part) if part else ():
                ids = self.words.get(word)
                if ids is None:
                    ids = self.merge([self.one[c] for c in word])
                    if len(word) <= LONGEST:
                        self.words = {} if len(self.words) >= REMEMBER else self.words
                        self.words[word] = ids
                out += ids
        return out

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """``merge`` of many words at once: in each step every word that can still merge does its first merge of the lowest rank."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids, word = self.of_byte[np.frombuffer(b"".join(words), np.uint8)], np.repeat(np.arange(len(words)), size)
        done_ids, done_words = [], []
        while len(ids):
            key = ids[:-1] << 32 | ids[1:]
            at = np.searchsorted(self.keys, key)
            rank = np.append(np.where((self.keys[at] == key) & (word[1:] == word[:-1]), self.ranks[at], NEVER), NEVER)
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(begin, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, begin), size)
            ended = least == NEVER
            done_ids.append(ids[ended])
            done_words.append(word[ended])
            hit = np.flatnonzero((rank == least) & ~ended)
            hit = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])] if len(hit) else hit
            ids[hit] = self.made[rank[hit]]
            left = ~ended
            left[hit + 1] = False
            ids, word = ids[left], word[left]
        ids, word = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (done_ids, done_words))
        order = np.argsort(word, kind="stable")
        cut = np.searchsorted(word[order], np.arange(len(words) + 1)).tolist()
        flat = ids[order].tolist()
        return [flat[a:b] for a, b in zip(cut, cut[1:])]  # noqa: B905

    def pieces_of(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of distinct pieces; short ones are remembered."""
        found = [self.pieces.get(p) for p in pieces]
        new = [k for k, ids in enumerate(found) if ids is None]
        plain = [k for k in new if len(pieces[k]) <= LONGEST and PLAIN.fullmatch(pieces[k])]
        for k, ids in zip(plain, self.merge_many([pieces[k] for k in plain]), strict=True):
            found[k] = ids
        for k in new:
            if found[k] is None:
                found[k] = self.encode(pieces[k].decode())
            if len(pieces[k]) <= LONGEST:
                self.pieces = {} if len(self.pieces) >= REMEMBER else self.pieces
                self.pieces[pieces[k]] = found[k]
        return found


@cache
def merger(path: str) -> Merger:
    """The merger of this Python worker, which serves all its tasks."""
    return Merger(path)


def _cut(data: np.ndarray, offsets: np.ndarray, m: Merger) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return (np.zeros(0, np.int64),) * 2
    start = piece_starts(data, offsets, [a.encode() for a in m.added])
    return start, np.diff(np.append(start, len(data)))


def _encode(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon, m: Merger) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first id of each text and the end) of texts."""
    start, size = _cut(data, offsets, m)
    number = lexicon.find(data, start, size)
    unseen = np.flatnonzero(number < 0)
    raw, own = data.tobytes(), {}
    of = [own.setdefault(raw[a:b], len(own)) for a, b in zip(start[unseen].tolist(), (start + size)[unseen].tolist(), strict=True)]
    number[unseen] = len(lexicon) + np.array(of, np.int64)
    found = m.pieces_of(list(own))
    first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
    out, count = spread(lexicon, number, first, np.fromiter(chain.from_iterable(found), np.int32, first[-1]))
    total = np.concatenate([[0], np.cumsum(count)])
    return out, total[np.searchsorted(start, offsets)]


def _decode(ids: np.ndarray, first: np.ndarray, m: Merger) -> pa.Array:
    """The texts of lists of ids. Bytes that are no UTF-8 become replacement characters, as in the library."""
    known = (ids >= 0) & (ids < len(m.first) - 1)
    at = np.where(known, ids, 0)
    size = np.where(known, m.first[at + 1] - m.first[at], 0)
    data = m.bytes[W.ranges(m.first[at], size)]
    offsets = np.concatenate([[0], np.cumsum(size)])[first]
    texts = pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        raw = data.tobytes()
        texts = pa.array([raw[a:b].decode(errors="replace") for a, b in zip(offsets, offsets[1:])], pa.large_string())  # noqa: B905
    return texts.cast(pa.string())


def _path(path: Callable[[], str] | str) -> str:
    return path() if callable(path) else path


def _count_pieces(path: Callable[[], str] | str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, held = merger(_path(path)), {}

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["piece", "n"])

        for rows in batches:
            for _, _, data, offsets in W.raw_chunks(rows.column("text")):
                start, size = _cut(data, offsets, m)
                keep = size <= LONGEST
                start, size = start[keep], size[keep]
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W._BYTE[data] * W._power(W._BASE, len(data))[: len(data)])])
                names = W.mix((total[start + size] - total[start]) * W._power(W._INVERSE, len(data))[start]) if len(start) else total[:0]
                _, at, count = np.unique(names, return_index=True, return_counts=True)
                raw = data.tobytes()
                for a, n, c in zip(start[at].tolist(), size[at].tolist(), count.tolist(), strict=True):
                    piece = raw[a : a + n]
                    held[piece] = held.get(piece, 0) + c
                if len(held) > HELD:
                    yield batch()
                    held.clear()
        if held:
            yield batch()

    return run


def frequent_lexicon(docs: DataFrame, path: Callable[[], str] | str, text_col: str = "text", words: int = WORDS) -> bytes:
    """The transducer of the most frequent pieces of all texts, at most ``words``. Its size is bounded by that and ``LONGEST``.

    A histogram of the pieces by their counts, to eight binary digits, says from which count on they are few enough;
    no task and not the driver sees more of them.
    """
    counts = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(_count_pieces(path), "piece binary, n long")
    counts = counts.groupBy("piece").agg(F.sum("n").alias("n")).withColumn("digits", F.greatest(F.length(F.bin("n")) - 8, F.lit(0)))
    counts = written(counts.select("piece", F.expr("shiftleft(shiftright(n, digits), digits)").alias("step")))
    least, total = None, 0
    for r in sorted(counts.groupBy("step").count().collect(), reverse=True):  # at most 128 steps for each power of two
        total += r["count"]
        if total > words:
            break
        least = r["step"]
    top = counts.where(F.col("step") >= least).select("piece").collect() if least is not None else []
    m = merger(_path(path))
    return compile_lexicon({(piece := bytes(r["piece"])): m.encode(piece.decode()) for r in top})


def _batches(path: Callable[[], str] | str, lexicon, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, own = merger(_path(path)), mapped_lexicon(lexicon.value, SparkFiles.getRootDirectory())
        for batch in batches:
            for a, b, data, offsets in W.raw_chunks(batch.column("text")):
                ids, first = _encode(data, offsets, own, m)
                columns = {"doc_id": batch.column("doc_id").slice(a, b - a), "ids": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))}
                if decoded:
                    columns["decoded"] = _decode(ids, first, m)
                yield pa.record_batch(list(columns.values()), names=list(columns))

    return run


def encode(docs: DataFrame, path: Callable[[], str] | str, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, decoded: bool = False) -> DataFrame:
    """``doc_id, ids`` of every row: the token ids of its whole text as the tokenizer file's library gives them.

    Special tokens are not added; their strings inside texts have their ids. ``decoded`` adds the text that the ids
    stand for. ``path`` is the file, or a function that finds it on the machine that calls. Null and empty texts have
    no ids; null and repeated ids each keep their row; other columns are not read; an empty table gives an empty result.
    A text is held by one task, with about 60 bytes of memory for each of its bytes.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    lexicon = docs.sparkSession.sparkContext.broadcast(frequent_lexicon(docs, path, text_col, words))
    more = StructType.fromDDL("ids array<int>, decoded string" if decoded else "ids array<int>")
    return rows.mapInArrow(_batches(path, lexicon, decoded), StructType([rows.schema["doc_id"], *more]))


def decode(rows: DataFrame, path: Callable[[], str] | str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the text of each list of ids (null lists and null, unknown or negative ids: nothing). A column of that name is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(_path(path))
        for batch in batches:
            lists = batch.column(ids_col).cast(pa.list_(pa.int64()))
            size = np.array([0 if v is None else v for v in lists.value_lengths().to_pylist()], np.int64)
            ids = lists.flatten().fill_null(-1).to_numpy()
            yield pa.record_batch([*batch.columns, _decode(ids, np.concatenate([[0], np.cumsum(size)]), m)], names=[*batch.schema.names, "decoded"])

    rows = rows.drop("decoded")
    return rows.mapInArrow(run, StructType([*rows.schema, *StructType.fromDDL("decoded string")]))
