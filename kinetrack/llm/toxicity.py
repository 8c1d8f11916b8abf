"""Toxicity scores with noisy-channel deobfuscation.

A text is split at white space once, and each distinct word is looked at once: words that look disguised
(a sign that may stand for a letter, or a doubled letter) and letters or signs that stand apart become a
lattice of the letters that each character may stand for. Viterbi decoding under a character trigram
model of the whole corpus restores the most likely word. Restored words are added to the text's own, and a
logistic model over words and word beginnings scores them. All steps are linear in the length of a text.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import written

#: What a sign may stand for. Fixed values.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou",
}
#: Costs (natural logarithms) of a sign for a letter, and of a letter that stands for a run of itself.
SIGN_COST, RUN_COST = 0.7, 0.3
SIGNS = re.escape("".join(STANDS_FOR))
UNIT = rf"(?:[^\W\d_]|[{SIGNS.replace(re.escape('*'), '')}])"
#: Three or more letters or signs apart, as far as they go. Nothing is given back, so the search is linear.
APART = re.compile(rf"(?<![\w{SIGNS}]){UNIT}(?:[\s.\-_*]++{UNIT}){{2,}}+")
BETWEEN, JOINED = re.compile(r"[\s.\-_*]"), re.compile(rf"[\w{SIGNS}]")
#: A sign or a doubled letter, in lower case.
DISGUISED = re.compile(rf"[{SIGNS}]|([^\W\d_])\1")
LETTER = re.compile(r"[^\W\d_]")
WORD = re.compile(r"[^\W_]+")
#: Signs that stand for no letter, between words of one run.
PIECES = re.compile(rf"(?:[^\w{SIGNS}]|_)+")
#: Labelled rows that are used to learn, at most.
TRAINING_ROWS = 20_000
#: Least labelled rows with a feature, and least share of toxic ones among them.
LEAST_ROWS, LEAST_SHARE = 4, 0.6
LETTERS = 28  # none, a to z, any other letter
_CLASS = np.zeros(256, np.int32)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = 27


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LETTERS**3, np.int64)
    for batch in batches:
        for _, _, data, offsets in W.raw_chunks(batch.column("text"), 1 << 18):
            # Two places without a letter stand before each text and after it.
            c = np.insert(_CLASS[W._LOWER[data]], np.repeat(offsets, 2), 0)
            total += np.bincount(c[:-2] * LETTERS**2 + c[1:-1] * LETTERS + c[2:], minlength=LETTERS**3)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["gram", "n"])


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Logarithms of P(third | first two) from the trigrams of all texts, smoothed by bigrams; shape 28 x 28 x 28."""
    counts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(_count_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    table = np.zeros(LETTERS**3)
    for r in counts.collect():  # at most 28 ** 3 rows
        table[r["gram"]] = r["n"]
    table = table.reshape((LETTERS,) * 3)
    pairs = table.sum(axis=0)
    one = (pairs.sum(axis=0) + 1) / (pairs.sum() + LETTERS)
    two = (pairs + 5 * one) / (pairs.sum(axis=1, keepdims=True) + 5)
    return np.log((table + 5 * two) / (table.sum(axis=2, keepdims=True) + 5))


#: Signs that stand for one letter become it, those for several stay, and others are noise between letters.
_ONE = {ord(c): x for c, x in STANDS_FOR.items() if len(x) == 1}
_SEVERAL = {c: x for c, x in STANDS_FOR.items() if len(x) > 1}
SEVERAL = re.compile(f"[{re.escape(''.join(_SEVERAL))}]")
NOISE = re.compile(rf"(?:[\W\d_](?<!{SEVERAL.pattern}))+")
RUN = re.compile(r"(.)\1+", re.S)


def cleaned(word: str) -> str:
    """A disguised word in lower case without signs at its ends and noise; signs that stand for one letter become it."""
    return NOISE.sub("", word.lower().strip(".,;:?\"'()[]{}<>-_").translate(_ONE))


def _class(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


@cache
def _choices(c: str, n: int) -> tuple[tuple[int, str, float], ...]:
    """(letter class, letters, cost) of a run of ``n`` (3: or more) of a letter or a sign for several."""
    signs = _SEVERAL.get(c, "")
    return tuple((_class(x), x * k, SIGN_COST * (x in signs) + RUN_COST * (n > k)) for x in signs or c for k in (1, 2)[: min(n, 2)])


def lattice(word: str) -> list[tuple[tuple[int, str, float], ...]]:
    """For each place of a disguised word: (letter class, letters, cost). Runs of a letter or sign may shrink to one or two."""
    return [_choices(m.group(1), min(3, m.end() - m.start())) for m in re.finditer(r"(.)\1*", cleaned(word), re.S)]


def restore(word: str, model: list[float]) -> str:
    """The likeliest letters of a disguised word (Viterbi over pairs of letters), in time linear in its length.

    ``model`` is the character model as a flat list. Where each sign stands for one letter, the paths of the lattice
    meet again at the letter after each run, so the best path is made of each run's better half.
    """
    low = cleaned(word)
    if SEVERAL.search(low):
        return _restore_any(low, model)

    def better(m: re.Match) -> str:
        c, a, b, text = m.group(1), m.start(), m.end(), m.string
        k, before, after = _class(c), _class(text[a - 1]) if a else 0, _class(text[b]) if b < len(text) else 0
        pair = (before * LETTERS + k) * LETTERS
        one = RUN_COST - model[pair + after]
        two = RUN_COST * (b - a > 2) - model[pair + k] - model[(k * LETTERS + k) * LETTERS + after]
        return c if one <= two else c + c

    return RUN.sub(better, low)


def _restore_any(word: str, model: list[float]) -> str:
    # A state is the last two letter classes, as first * 28 + second.
    paths: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    for options in lattice(word):
        new: dict[int, tuple[float, tuple]] = {}
        for state, (cost, text) in paths.items():
            b = state % LETTERS
            for k, letters, own in options:
                c, to = cost + own - model[state * LETTERS + k], b * LETTERS + k
                if len(letters) == 2:
                    c -= model[to * LETTERS + k]
                    to = k * LETTERS + k
                if to not in new or c < new[to][0]:
                    new[to] = (c, (text, letters))
        paths = new
    _, text = min(((c - model[s * LETTERS], t) for s, (c, t) in paths.items()), key=lambda e: e[0])
    out = []
    while text:
        text, letters = text
        out.append(letters)
    return "".join(reversed(out))


def readings(word: str) -> list[str]:
    """What is decoded of a disguised word: the whole, its pieces between signs for no letter, and these without the signs that may be punctuation at their ends."""
    pieces = [p for p in PIECES.split(word) if len(p) > 1]
    return list(dict.fromkeys([word, *pieces, *(q for p in pieces if len(q := p.strip("!|+(*")) > 1)]))


def apart(text: str) -> set[str]:
    """The words that letters or signs apart spell. The first and the last letter may be words of their own.

    Stars alone between letters are separators, among others they stand for a letter.
    """
    found = set()
    for run in apart_runs(text):
        if LETTER.search(run):
            units = [c for c in re.split(r"[\s.\-_]+", run) if c]
            units = "".join(units) if len(units) > 1 and max(map(len, units)) == 1 else run.translate(_NO_SEPARATORS)
            found |= {units, units[1:], units[:-1]} if len(units) > 3 else {units}
    return found


_NO_SEPARATORS = {ord(c): None for c in " \t\n\r\f\v.-_*"}


def features_of(word: str) -> list[str]:
    """The features of a word in lower case: itself and its first 4, 5 and 6 letters. A very long word is named by a digest."""
    return [word if len(word) <= 64 else hashlib.blake2b(word.encode(), digest_size=16).hexdigest(), *(word[:k] + "*" for k in (4, 5, 6) if len(word) > k)]


#: Characters of a text that are split at once, and words a Python worker remembers: at most, and the longest.
SEGMENT, REMEMBER, REMEMBERED = 1 << 20, 1 << 17, 32
_SPACE = re.compile(r"\s")


def segments(text: str) -> Iterator[str]:
    """The text in parts that end at white space, so that no word is cut."""
    start = 0
    while start < len(text):
        end = _SPACE.search(text, start + SEGMENT) if len(text) - start > SEGMENT else None
        end = end.start() if end else len(text)
        yield text[start:end]
        start = end


def words_of(word: str, letters: list[float]) -> set[str]:
    """The words in lower case of a run without white space, the restored ones included."""
    low = word.lower()
    found = set(WORD.findall(low))
    if DISGUISED.search(low) and LETTER.search(low):
        for r in readings(low):
            found.add(restore(r, letters))
    found.discard("")
    return found


def apart_runs(text: str) -> Iterator[str]:
    """Runs of three or more letters or signs apart, up to the last one that nothing is joined to."""
    for m in APART.finditer(text):
        begin, end = m.span()
        while end > begin and end < len(text) and JOINED.match(text, end):
            end -= 1
            while end > begin and BETWEEN.match(text, end - 1):
                end -= 1
        if len(BETWEEN.sub("", text[begin:end])) > 2:
            yield text[begin:end]


def all_words(text: str, letters: list[float], known: dict[str, set[str]]) -> set[str]:
    """All words of a text in lower case, the restored ones included; ``known`` remembers those of runs."""
    found: set[str] = set()
    for part in segments(text):
        for w in set(part.split()):
            own = known.get(w)
            if own is None:
                own = words_of(w, letters)
                if len(w) <= REMEMBERED:
                    if len(known) >= REMEMBER:
                        known.clear()
                    known[w] = own
            found |= own
    found |= {restore(u, letters) for u in apart(text)}
    return found


@dataclass
class Model:
    """The character model as a flat list, features with their weights, and the bias."""

    letters: list[float]
    weights: dict[str, float]
    bias: float
    known: dict[str, tuple[str, ...]] = field(default_factory=dict, compare=False)
    begins: set[str] | None = field(default=None, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "begins": None}

    def telling(self, words: set[str]) -> tuple[str, ...]:
        """The features of the model that the words have. Each begins like its word, long words aside."""
        if self.begins is None:
            self.begins = {f[:4] for f in self.weights}
        near = [w for w in words if w[:4] in self.begins or len(w) > 64]
        return tuple(f for w in near for f in features_of(w) if f in self.weights)

    def score(self, text: str) -> float:
        """The probability that the text is toxic. What a word tells is remembered by the Python worker."""
        found: set[str] = set()
        known = self.known
        for part in segments(text):
            for w in set(part.split()):
                own = known.get(w)
                if own is None:
                    own = self.telling(words_of(w, self.letters))
                    if len(w) <= REMEMBERED:
                        if len(known) >= REMEMBER:
                            known.clear()
                        known[w] = own
                if own:
                    found.update(own)
        for u in apart(text):
            found.update(self.telling({restore(u, self.letters)}))
        total = self.bias + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))

    def scores(self, texts: pa.Array) -> list[float]:
        """Scores of a column, a bounded number of texts at a time; null texts are empty."""
        out: list[float] = []
        for a, b, _, _ in W.raw_chunks(texts):
            out += [self.score(t or "") for t in texts.slice(a, b - a).to_pylist()]
        return out


def _learn_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """``text, y`` of at most ``rows`` labelled documents, by a hash of the id; an id with several labels is toxic if one is."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id").select("text", "y")  # bounded by ``rows``


def _words_of_rows(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, set[str]] = {}
        for batch in batches:
            for a, b, _, _ in W.raw_chunks(batch.column("text")):
                own = [sorted(all_words(t, sent.value, known)) for t in batch.column("text").slice(a, b - a).to_pylist()]
                yield pa.record_batch([batch.column("y").slice(a, b - a), pa.array(own, pa.list_(pa.string()))], names=["y", "words"])

    return run


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for y, words in zip(batch.column("y").to_pylist(), batch.column("words").to_pylist(), strict=True):
            count[int(y > 0)].update({f for w in words for f in features_of(w)})
    for y, own in count.items():
        yield pa.record_batch([pa.array(list(own), pa.string()), pa.array([n * y for n in own.values()], pa.int64()), pa.array(list(own.values()), pa.int64())], names=["feature", "t", "n"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAINING_ROWS) -> Model:
    """The character model of all ``docs`` and a logistic model of at most ``rows`` labelled ones.

    Its features are all words and word beginnings that at least ``LEAST_ROWS`` of these rows have, toxic
    ones to ``LEAST_SHARE``, so the model does not depend on how the rows are dealt. Labels of unknown
    documents and null labels are ignored. Without labels the model scores everything 0.
    """
    letters = character_model(docs, text_col).ravel().tolist()
    sent = docs.sparkSession.sparkContext.broadcast(letters)
    sample = written(_learn_rows(docs, labels, id_col, text_col, label_col, rows).mapInArrow(_words_of_rows(sent), "y int, words array<string>"))
    counts = sample.mapInArrow(_count_features, "feature string, t long, n long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    telling = counts.where((F.col("t") >= LEAST_ROWS) & (F.col("t") >= LEAST_SHARE * F.col("n")))
    chosen = sorted(r["feature"] for r in telling.select("feature").collect())  # of the bounded sample
    number = {f: i for i, f in enumerate(chosen)}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted({number[f] for w in words for f in features_of(w) if f in number}) for words in batch.column("words").to_pylist()]
            yield pa.record_batch([batch.column("y"), pa.array(own, pa.list_(pa.int64()))], names=["y", "f"])

    rows_ = sample.mapInArrow(found, "y int, f array<long>").groupBy("y", "f").count().collect()  # bounded by ``rows``
    weights, bias = fit(rows_, len(chosen))
    return Model(letters, {f: float(w) for f, w in zip(chosen, weights, strict=True) if w > 0}, bias)


def fit(rows: list, features: int, rounds: int = 3000, penalty: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights (not below 0) and bias of a logistic model from (label, features, rows) triples."""
    w, bias = np.zeros(features), -3.0
    rows = sorted((tuple(r["f"]), r["y"], r["count"]) for r in rows)
    if not rows or not features or not any(y for _, y, _ in rows):
        return w, -20.0
    y, n = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    n /= np.where(y > 0, n[y > 0].sum(), max(1.0, n[y == 0].sum())) * 2  # toxic and clean rows weigh the same together
    doc = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    feature = np.array([f for r in rows for f in r[0]], np.int64)
    step = 8 / max(1.0, float(np.bincount(doc, minlength=len(rows)).mean()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, w[feature], len(rows)) + bias, -30, 30)))
        g = n * (p - y)
        w = np.maximum(0, w - step * (np.bincount(feature, g[doc], features) + penalty * w))
        bias = min(-2.0, bias - step * g.sum())
    return w, float(bias)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5) to ``docs``, from the whole text alone.

    Null texts are empty; an empty text scores as one without any telling word. Columns with the added
    names are replaced, whatever else a table has passes through; repeated rows each get the same score. Texts of
    any length are read whole, a part at a time. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.drop("score", "predicted").withColumn("score", F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(sent.value.scores(batch.column(text_col)), pa.float64())
            yield batch.set_column(batch.schema.get_field_index("score"), batch.schema.field("score"), found)

    return out.mapInArrow(run, out.schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with their own columns and values, whatever their names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([s < 0.5 for s in sent.value.scores(batch.column(text_col))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
