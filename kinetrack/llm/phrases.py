"""Phrases of two to five words that stand together more often than their parts explain.

Every stretch of up to ``LONGEST`` words inside a piece of text is hashed by a Rabin-Karp fingerprint, the
difference of two prefix polynomials over the piece's bytes. Tasks count the fingerprints of their texts and
the shuffle adds the counts up, in three passes: single words, then pairs of frequent words, then longer
stretches all of whose pairs are frequent. What is frequent is sent on as a table of bits of fixed size; bits
that two fingerprints share only let more stretches through. A last pass counts the stretches whose
fingerprints are frequent by their words: a chunk of text keeps a pointer to one occurrence of each
fingerprint, compares the bytes of all others with it, and writes out the phrase it points to. So fingerprints
choose what is looked at, the text says what is equal, and only frequent phrases become strings. Counts are
shuffled in packed rows, one for each bucket of fingerprints or phrases.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .packed import pack, pack_sorted, unpack, unpack_sorted
from .tables import text_or_empty, written

LEAST, LONGEST, TOP = 100, 5, 2000
#: Bits of a fingerprint that are counted. The tables of frequent ones have 2 ** BITS bits (16 MB).
PRINT, BITS = 48, 27
#: Bytes of text whose stretches one bucket of the shuffle has.
BUCKET_BYTES = 1 << 22
#: Distinct fingerprints and phrases that a task holds before it passes their counts on.
HELD, HELD_PHRASES = 1 << 20, 1 << 18

_WORD, _SPACE, _BREAK = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 32]] = _SPACE
_CLASS[[*b".,;:!?", *range(10, 14)]] = _BREAK


class Stretches:
    """The words of some texts, each followed by one space, and the fingerprints of stretches of words.

    ``piece`` numbers the pieces, so that a stretch from word i to word j is inside one if their numbers are equal.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = W._LOWER[data]
        w = W.split(data, offsets, _CLASS == _WORD, lower=False)
        self.first = w.first
        size = w.end - w.start + 1
        self.stop = np.cumsum(size)
        self.start = self.stop - size
        self.bytes = np.append(data, np.uint8(32))[W.ranges(w.start, size)]
        self.bytes[self.stop - 1] = 32
        breaks = np.concatenate([[0], np.cumsum(_CLASS[data] == _BREAK)])[w.start]
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))
        changed = (breaks[1:] != breaks[:-1]) | (doc[1:] != doc[:-1])
        self.piece = np.concatenate([[0], np.cumsum(changed)]) if len(doc) else doc
        n = len(self.bytes)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(W._BYTE[self.bytes] * W._power(W._BASE, n)[:n], out=self.prefix[1:])
        self.inverse = W._power(W._INVERSE, n)

    def places(self, k: int) -> np.ndarray:
        """First words of the stretches of k words."""
        n = len(self.piece) - k + 1
        return np.flatnonzero(self.piece[:n] == self.piece[k - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def prints(self, at: np.ndarray, k: int, salt: np.ndarray) -> np.ndarray:
        """Fingerprints of the stretches of k words from ``at``; ``salt`` has a value for each text."""
        h = (self.prefix[self.stop[at + k - 1] - 1] - self.prefix[self.start[at]]) * self.inverse[self.start[at]]
        return W.mix(h ^ salt[np.searchsorted(self.first, at, "right") - 1])


def _marked(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    spot = prints >> np.uint64(64 - (8 * len(bits) - 1).bit_length())
    return (bits[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Stretches, np.ndarray, list]]:
    """(stretches, salt of each text, language of each text) of consecutive rows."""
    for batch in batches:
        salts = batch.column("salt").to_numpy().view(np.uint64)
        langs = batch.column("lang")
        for a, b, data, offsets in W.raw_chunks(batch.column("text")):
            yield Stretches(data, offsets), salts[a:b], langs.slice(a, b - a)


def _counted(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints of several counts, and the sums of their counts."""
    prints, counts = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.argsort(prints)
    prints, counts = prints[order], counts[order]
    new = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
    return prints[new], np.add.reduceat(counts, new)


def _rows(bucket: np.ndarray, size: int) -> Iterator[tuple[int, slice]]:
    """Each bucket that occurs, and where it lies in the ascending ``bucket``."""
    cut = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1))
    yield from ((int(bucket[a]), slice(a, b)) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), size], strict=True))


def _count_prints(chosen: Callable[[Stretches, np.ndarray], Iterator[np.ndarray]], bits: int):
    """Counts of the fingerprints that ``chosen`` gives for the stretches of a chunk, as rows of one for each of 2 ** ``bits`` buckets."""

    def batch(held: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        prints, counts = held
        rows = [(k, pack_sorted(prints[own]), pack(counts[own].astype(np.uint64))) for k, own in _rows((prints >> np.uint64(PRINT - bits)).astype(np.int64), len(prints))]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "prints", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for stretches, salt, _ in _chunks(batches):
            for prints in chosen(stretches, salt):
                if len(prints):
                    held.append(np.unique(prints >> np.uint64(64 - PRINT), return_counts=True))
                    size += len(held[-1][0])
            if size > 2 * HELD:
                held = [_counted(held)]
                size = len(held[0][0])
                if size > HELD:
                    yield batch(held[0])
                    held, size = [], 0
        if held:
            yield batch(_counted(held))

    return run


def _frequent_bits(texts: DataFrame, chosen: Callable[[Stretches, np.ndarray], Iterator[np.ndarray]], least: int, bits: int) -> np.ndarray:
    """Table of bits of the fingerprints that occur ``least`` times or more. Its size is fixed."""
    size = BITS

    def to_bits(table: pa.Table) -> pa.Table:
        cells = zip(table.column("prints").to_pylist(), table.column("counts").to_pylist(), strict=True)
        prints, counts = _counted([(unpack_sorted(p), unpack(c, np.uint64)) for p, c in cells])
        spots = np.unique(prints[counts >= least] >> np.uint64(PRINT - size)).astype(np.uint32)
        return pa.table({"spots": pa.array([pack(np.diff(spots, prepend=np.uint32(0)))], pa.binary())})

    rows = texts.mapInArrow(_count_prints(chosen, bits), "bucket long, prints binary, counts binary")
    found = np.zeros(1 << size, bool)
    # At most one number for each bit, as compressed steps.
    for r in rows.groupBy("bucket").applyInArrow(to_bits, "spots binary").collect():
        found[np.cumsum(unpack(r["spots"], np.uint32), dtype=np.uint32)] = True
    return np.packbits(found, bitorder="little")


def _frequent_pairs(s: Stretches, salt: np.ndarray, words: np.ndarray) -> np.ndarray:
    """First words of the pairs of words that ``words`` marks."""
    ok = _marked(words, s.prints(np.arange(len(s.piece)), 1, salt))
    at = s.places(2)
    return at[ok[at] & ok[at + 1]]


def _frequent_longer(s: Stretches, salt: np.ndarray, pairs: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, first words) of the stretches of three words and more all of whose pairs ``pairs`` marks."""
    at = s.places(2)
    ok = np.zeros(len(s.piece) + longest, bool)
    ok[at] = _marked(pairs, s.prints(at, 2, salt))
    at = at[ok[at]]
    for k in range(3, longest + 1):
        at = at[ok[at + k - 2]]  # a pair never crosses pieces, so neither does a chain of pairs
        yield k, at


def _spell(words, pairs, longer, longest: int, bits: int):
    """Counts of the marked stretches by language and phrase, and of all words as the empty phrase, as rows of one for each of 2 ** ``bits`` buckets."""

    def stretches_of(s: Stretches, salt: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        every = [(1, np.arange(len(s.piece)), words), (2, _frequent_pairs(s, salt, words.value), pairs)]
        for k, at, marks in [*every, *((k, at, longer) for k, at in _frequent_longer(s, salt, pairs.value, longest))]:
            prints = s.prints(at, k, salt)
            ok = _marked(marks.value, prints)
            yield k, at[ok], prints[ok]

    def spelled(s: Stretches, lang: np.ndarray, k: int, at: np.ndarray, prints: np.ndarray) -> Iterator[tuple[int, bytes, int]]:
        """(first word, phrase, count) of stretches; those of one fingerprint are compared with the first of them. ``lang`` numbers each word's language."""
        _, pointer, of, counts = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
        start, stop = s.start[at], s.stop[at + k - 1] - 1
        here, there, size = start, start[pointer][of], stop - start
        differ = (size != (stop - start)[pointer][of]) | (lang[at] != lang[at][pointer][of])
        same = np.flatnonzero(~differ)
        wrong = s.bytes[W.ranges(here[same], size[same])] != s.bytes[W.ranges(there[same], size[same])]
        if wrong.any():
            differ[same[np.searchsorted(np.cumsum(size[same]), np.flatnonzero(wrong), "right")]] = True
        raw = s.bytes.tobytes()
        if differ.any():
            counts = counts - np.bincount(of[differ], minlength=len(counts))
            for i in np.flatnonzero(differ).tolist():
                yield int(at[i]), raw[start[i] : stop[i]], 1
        for i, n in zip(pointer.tolist(), counts.tolist(), strict=True):
            yield int(at[i]), raw[start[i] : stop[i]], n

    def batch(held: dict) -> pa.RecordBatch:
        # No language or phrase holds a line end: languages come as numbers, phrases never cross one.
        langs = sorted({k[0] for k in held})
        number = {x: b"%d" % i for i, x in enumerate(langs)}
        lines = [number[lang] + b" " + phrase for lang, phrase, _ in held]
        n = np.fromiter(held.values(), np.uint64, len(held))
        bucket = np.fromiter((zlib.crc32(line) >> (32 - bits) for line in (f"{lang}\0".encode() + phrase for lang, phrase, _ in held)), np.int64, len(held))
        order = np.argsort(bucket, kind="stable")
        rows = [(k, langs, pa.compress(b"\n".join(lines[i] for i in order[own].tolist()), "zstd", asbytes=True), sum(len(lines[i]) + 1 for i in order[own].tolist()) - 1, pack(n[order[own]])) for k, own in _rows(bucket[order], len(n))]
        kinds = (pa.int64(), pa.list_(pa.string()), pa.binary(), pa.int64(), pa.binary())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "langs", "lines", "size", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for s, salt, langs in _chunks(batches):
            lang, words_of = langs.to_pylist(), np.diff(s.first)
            doc, number = np.repeat(np.arange(len(lang)), words_of), np.unique(np.array(lang, object), return_inverse=True)[1]
            for name, n in zip(lang, words_of.tolist(), strict=True):
                held[name, b"", 0] = held.get((name, b"", 0), 0) + n
            for k, at, prints in stretches_of(s, salt):
                for i, phrase, n in spelled(s, number[doc], k, at, prints):
                    key = (lang[doc[i]], phrase, k)
                    held[key] = held.get(key, 0) + n
            if len(held) > HELD_PHRASES:
                yield batch(held)
                held = {}
        if held:
            yield batch(held)

    return run


def _add_up(least: int):
    """The phrases of a bucket that occur ``least`` times or more, and the numbers of all words."""

    def run(table: pa.Table) -> pa.Table:
        total: dict = {}
        for r in table.to_pylist():
            lines = pa.decompress(r["lines"], r["size"], "zstd", asbytes=True).split(b"\n")
            for line, n in zip(lines, unpack(r["counts"], np.uint64).tolist(), strict=True):
                number, _, phrase = line.partition(b" ")
                key = r["langs"][int(number)], phrase
                total[key] = total.get(key, 0) + n
        kept = [(lang, p.decode(), p.count(b" ") + 1 if p else 0, n) for (lang, p), n in total.items() if n >= least or not p]
        return pa.table({c: pa.array(v, t) for (c, t), v in zip({"lang": pa.string(), "phrase": pa.string(), "words": pa.int32(), "n": pa.int64()}.items(), zip(*kept, strict=True) if kept else [[]] * 4, strict=True)})

    return run


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """``lang, phrase, words, n``: the exact count of each phrase of up to ``longest`` words that occurs ``least`` times or more in its language.

    The row with the empty phrase and 0 words counts all words of the language. The result is written.
    """
    lang = F.coalesce(F.col(lang_col), F.lit("und"))
    texts = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("salt"), text_or_empty(text_col).alias("text"))
    context = docs.sparkSession.sparkContext
    # So many buckets that each has a bounded share of the stretches, however many there are.
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(32, max(6, (size // BUCKET_BYTES).bit_length()))

    words = context.broadcast(_frequent_bits(texts, lambda s, salt: iter([s.prints(np.arange(len(s.piece)), 1, salt)]), least, bits))
    pairs = context.broadcast(_frequent_bits(texts, lambda s, salt: iter([s.prints(_frequent_pairs(s, salt, words.value), 2, salt)]), least, bits))
    longer = context.broadcast(_frequent_bits(texts, lambda s, salt: (s.prints(at, k, salt) for k, at in _frequent_longer(s, salt, pairs.value, longest)), least, bits))
    rows = texts.mapInArrow(_spell(words, pairs, longer, longest, bits), "bucket long, langs array<string>, lines binary, size long, counts binary")
    return written(rows.groupBy("bucket").applyInArrow(_add_up(least), "lang string, phrase string, words int, n long"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, percent: int = 100) -> DataFrame:
    """``lang, rank, phrase, words, a, l, r, n, score``: the ``top`` phrases of each language by their lowest-scoring cut.

    Texts are lower-cased (A to Z) and cut into pieces at sentence signs and line ends, pieces into words at spaces
    and tabs. A phrase of 2 to ``longest`` words that occurs a >= ``least`` times in its language (null: ``und``) is
    a candidate. A cut after its first words gives l and r, how often either part occurs, and the score
    floor(1000 * a * n / (l * r)) with n, the number of the language's words; ties go to the earliest cut.
    Candidates inside a longer one that occurs at least ``percent`` hundredths as often are dropped. Ranks go by
    score, a, and then the phrase in byte order.

    Null and empty texts have no words; repeated rows count again; other columns are not read; an empty table gives an
    empty result. A text is held by one task, in chunks with others.
    """
    found = frequent_phrases(docs, text_col, lang_col, least, longest)
    total = found.where("words = 0").select("lang", F.col("n").alias("n_all"))
    phrases = found.where("words > 0")
    candidates = phrases.where("words > 1").withColumnRenamed("n", "a")

    join = lambda a, b: F.array_join(F.slice(F.split("phrase", " "), a, b), " ")
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: join(i, k)))))
    inside = candidates.where("words > 2").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(inside, ["lang", "phrase"], "left").where("longer is null or 100 * longer < a * %d" % percent).drop("longer")

    cuts = F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), join(F.lit(1), k).alias("left"), join(k + 1, F.col("words") - k).alias("right"))))
    rows = kept.select("lang", "phrase", "words", "a", cuts.alias("c")).select("lang", "phrase", "words", "a", "c.*")
    for side, name in (("left", "l"), ("right", "r")):
        rows = rows.join(phrases.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    # The totals are one row for each language; adaptive execution sends them once it has seen how few they are.
    rows = rows.join(total, "lang")
    score = F.expr("cast(1000 as decimal(38,0)) * a * n_all div (cast(l as decimal(38,0)) * r)")
    best = rows.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r", F.col("n_all").alias("n"))).alias("best"))
    rank = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.select("lang", "phrase", "words", "a", "best.l", "best.r", "best.n", "best.score").withColumn("rank", F.row_number().over(rank).cast("long")).where(F.col("rank") <= top)
