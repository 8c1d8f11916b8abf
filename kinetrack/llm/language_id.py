"""Language identification by hierarchical discrimination.

A first set of linear support vector machines separates language families; inside the winning family,
one-versus-one machines separate the languages. Features are the square roots of the relative
frequencies of hashed 1-, 2- and 3-byte grams of the whole text, so every document has unit length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

#: Related languages. ISO 639-1 codes by family. A language in no family is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr"),
}
DIMENSIONS = 4096
#: Training rows of each language, about: a bounded sample, chosen by a hash of the id.
ROWS_PER_LANGUAGE = 400
UNDETERMINED = "und"


def features(data: np.ndarray, offsets: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """One row for each document: square roots of relative frequencies of its hashed byte grams."""
    n = len(offsets) - 1
    low = W._LOWER[data].astype(np.uint32)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(low))  # bytes to the end of the document
    counts = np.zeros(n * dimensions)
    gram = np.zeros(len(low), np.uint32)
    for order in (1, 2, 3):
        gram[: len(low) - order + 1] = gram[: len(low) - order + 1] * np.uint32(257) + low[order - 1 :] + np.uint32(1)
        bucket = (gram * np.uint32(2654435761) + np.uint32(order * 97)) >> np.uint32(32 - int(dimensions).bit_length() + 1)
        ok = left >= order
        counts += np.bincount(doc[ok] * dimensions + bucket[ok], minlength=n * dimensions)
    counts = counts.reshape(n, dimensions)
    total = counts.sum(axis=1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1)).astype(np.float32)


def train_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-5, rounds: int = 400) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, classes weighted equally (accelerated gradient)."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = penalty * v - 2 * (x.T @ (weight * slack * y))
        new = v - grad / (4 + penalty)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + np.float32((t - 1) / t2) * (new - w), new, t2
    return w


@dataclass
class Duels:
    """One-versus-one machines among some classes."""

    classes: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None

    @classmethod
    def fit(cls, x: np.ndarray, names: np.ndarray) -> Duels:
        out = cls(sorted(set(names.tolist())))
        out.pairs = list(combinations(range(len(out.classes)), 2))
        machines = []
        for a, b in out.pairs:
            own = np.isin(names, [out.classes[a], out.classes[b]])
            machines.append(train_svm(x[own], np.where(names[own] == out.classes[a], 1, -1).astype(np.float32)))
        out.weights = np.stack(machines, axis=1) if machines else None
        return out

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The winning class (most duels, then largest margins) and its confidence, the least over its duels."""
        if self.weights is None:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margin = x @ self.weights[:-1] + self.weights[-1]
        votes = np.zeros((len(x), len(self.classes)))
        trust = np.ones((len(x), len(self.classes)))
        for k, (a, b) in enumerate(self.pairs):
            p = 1 / (1 + np.exp(-np.clip(4 * margin[:, k], -30, 30)))
            votes[:, a] += (margin[:, k] >= 0) + 1e-3 * p
            votes[:, b] += (margin[:, k] < 0) + 1e-3 * (1 - p)
            trust[:, a], trust[:, b] = np.minimum(trust[:, a], p), np.minimum(trust[:, b], 1 - p)
        best = votes.argmax(axis=1)
        return best, trust[np.arange(len(x)), best]


@dataclass
class Model:
    families: Duels
    inside: dict[str, Duels]
    dimensions: int

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        first, trust = self.families.decide(x)
        langs = np.empty(len(x), object)
        for f, name in enumerate(self.families.classes):
            own = np.flatnonzero(first == f)
            if len(own):
                best, p = self.inside[name].decide(x[own])
                langs[own] = np.array(self.inside[name].classes, object)[best]
                trust[own] *= p
        return langs.tolist(), np.clip(trust, 0, 1)


def _featured(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in W.raw_chunks(batch.column("text")):
                x = features(data, offsets, dimensions)
                yield pa.record_batch([batch.column("lang").slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, dimensions: int = DIMENSIONS, families: dict[str, tuple[str, ...]] = FAMILIES) -> Model | None:
    """Fit on about ``rows_per_language`` rows of each language, chosen by a hash of the id over all rows.

    Rows with a null id, text or language are not used. None if there are no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("id is not null and text is not null and text <> '' and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(5)), F.lit(1_000_000))
    quota = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1_000_000, -(-rows_per_language * 1_000_000 // n)))])
    got = rows.where(draw < quota[F.col("lang")]).select("text", "lang").mapInArrow(_featured(dimensions), "lang string, x binary").orderBy("lang", "x").collect()
    if not got:
        return None
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got])
    names = np.array([r["lang"] for r in got], object)
    of = {lang: f for f, langs in families.items() for lang in langs}
    kinds = np.array([of.get(n, n) for n in names], object)
    inside = {f: Duels.fit(x[kinds == f], names[kinds == f]) for f in set(kinds.tolist())}
    return Model(Duels.fit(x, kinds), inside, dimensions)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to ``docs``, from the whole text alone.

    A null text, a text without a letter (an empty one, too) and any text without a model are ``und``
    with score 0. Columns with the added names are replaced; repeated rows each get their prediction. Of languages
    with equal votes and margins the first by name wins. A very long text is counted whole. An empty table gives an
    empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    marked = docs.drop("lang_pred", "score").withColumns({"lang_pred": F.when(F.col(text_col).rlike(r"\p{L}"), F.lit("")).otherwise(F.lit(UNDETERMINED)), "score": F.lit(0.0)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for a, b, data, offsets in W.raw_chunks(batch.column(text_col)):
                rows = batch.slice(a, b - a)
                known = np.array([v == "" for v in rows.column("lang_pred").to_pylist()]) & (m is not None)
                langs, score = m.predict(features(data, offsets, m.dimensions)) if m else ([], np.zeros(b - a))
                langs = [langs[i] if k else UNDETERMINED for i, k in enumerate(known)]
                rows = rows.set_column(rows.schema.get_field_index("lang_pred"), "lang_pred", pa.array(langs, pa.string()))
                yield rows.set_column(rows.schema.get_field_index("score"), "score", pa.array(np.where(known, score, 0.0), pa.float64()))

    return marked.mapInArrow(run, marked.schema)
