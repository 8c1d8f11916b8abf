"""Token counts with overlap resynchronisation for very long documents.

A long text is cut into chunks that overlap, the chunks are spread over the cluster and each is encoded
with offsets. Inside the overlap of two neighbours, a place is proven stable if both encodings start a
token there, at a space after a character that is not white space: the tokens on either side do not
depend on what lies beyond. The chunks are spliced at the first such place. Where an overlap has none,
the document's overlaps are widened, up to the whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import words as W
from .tables import numbered, written
from .tokens import UNUSUAL, encoder, tokenizer

#: Bytes from which a text is cut, bytes of a chunk, and first overlap.
HUGE, CHUNK, OVERLAP, WIDEN = 32_768, 16_384, 256, 8
SPACES = " \t\n\r\f\v"


def _count_short(path: Callable[[], str] | str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path() if callable(path) else path)
        for batch in batches:
            for a, b, data, offsets in W.raw_chunks(batch.column("text")):
                codes, parts = own.codes(data, offsets)
                total = np.concatenate([[0], np.cumsum(own.count[codes])])
                ends = np.cumsum(parts)
                yield pa.record_batch([batch.column(c).slice(a, b - a) for c in ("doc_id", "n_bytes")] + [pa.array(total[ends] - total[ends - parts])], names=["doc_id", "n_bytes", "n_tokens"])

    return count


def stable_starts(text: str, starts: list[int]) -> list[int]:
    """Token starts (character offsets) at a space whose predecessor is not white space of any kind."""
    return [s for s in starts if 0 < s < len(text) and text[s] in SPACES and not text[s - 1].isspace() and not UNUSUAL.match(text[s - 1])]


def _encode_chunks(path: Callable[[], str] | str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    places = pa.map_(pa.int64(), pa.int64())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = tokenizer(path() if callable(path) else path)
        for batch in batches:
            rows = batch.to_pylist()
            out = {"rid": [], "k": [], "n": [], "head": [], "tail": []}
            for r in rows:
                raw = r["body"]
                skip = 0  # a chunk may begin inside a character
                while skip < min(4, len(raw)) and raw[skip] & 0xC0 == 0x80 and r["begin"]:
                    skip += 1
                text = raw[skip:].decode("utf-8", errors="ignore")
                found = library.encode(text, add_special_tokens=False)
                at = np.array([o[0] for o in found.offsets], np.int64)
                proven = set(stable_starts(text, sorted(set(at.tolist()))))
                code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                byte = np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))]) + skip + r["begin"]
                head, tail = [], []
                previous = -1
                for i, s in enumerate(at.tolist()):
                    if s != previous and s in proven:
                        p = int(byte[s])
                        if p < r["begin"] + r["overlap"]:
                            head.append((p, i))
                        if p >= r["stop"]:
                            tail.append((p, i))
                    previous = s
                for c, v in zip(out, (r["rid"], r["k"], len(found), head, tail), strict=True):
                    out[c].append(v)
            yield pa.record_batch([pa.array(out["rid"], pa.int64()), pa.array(out["k"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["head"], places), pa.array(out["tail"], places)], names=list(out))

    return encode


def _chunk_rows(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """One row per chunk of ``texts`` (``rid, bytes``): chunk k has the bytes from k * chunk to the next start plus the overlap."""
    n = F.octet_length("bytes")
    last = F.greatest(F.lit(0), F.ceil((n - F.lit(overlap)) / chunk) - 1).cast("long")
    pieces = F.transform(
        F.sequence(F.lit(0).cast("long"), last),
        lambda k: F.struct(k.alias("k"), (k * chunk).alias("begin"), ((k + 1) * chunk).alias("stop"), F.substring(F.col("bytes"), (k * chunk + 1).cast("int"), F.lit(chunk + overlap)).alias("body")),
    )
    rows = texts.select("rid", F.explode(pieces).alias("c")).select("rid", "c.*", F.lit(overlap).cast("long").alias("overlap"))
    # A stated count, so that few large chunks are not put into few tasks.
    return rows.repartition(max(64, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64("rid", "k"))


def count_long(texts: DataFrame, path: Callable[[], str] | str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``rid, n_tokens`` of ``texts`` (``rid, bytes``) by overlapping chunks."""
    done = None
    while True:
        coded = _chunk_rows(texts, chunk, overlap).mapInArrow(_encode_chunks(path), "rid long, k long, n long, head map<long,long>, tail map<long,long>")
        w = Window.partitionBy("rid").orderBy("k")
        both = coded.withColumns({"next": F.lead("head").over(w), "last": F.lead("k").over(w).isNull()})
        both = both.withColumn("cut", F.array_min(F.array_intersect(F.map_keys("tail"), F.map_keys("next"))))
        both = both.withColumn("from", F.lag("cut").over(w))
        part = F.when(F.col("last"), F.col("n")).otherwise(F.try_element_at("tail", F.col("cut"))) - F.when(F.col("k") == 0, 0).otherwise(F.try_element_at("head", F.col("from")))
        # A part is null where an overlap has no common place; then the sum must not be used.
        found = written(both.groupBy("rid").agg(F.sum(part).alias("n_tokens"), F.count(part).alias("spliced"), F.count("*").alias("parts")))
        good = found.where("spliced = parts").select("rid", "n_tokens")
        done = good if done is None else done.union(good)
        failed = found.where("spliced < parts").select("rid")
        if failed.isEmpty():
            return done
        texts = texts.join(failed, "rid", "left_semi")
        overlap *= WIDEN
        chunk = max(chunk, 4 * overlap)


def count_tokens(docs: DataFrame, path: Callable[[], str] | str, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row, as the tokenizer file's library gives them for the whole text.

    ``path`` is the file, or a function that finds it on the executor. Null texts are empty and have no
    tokens; null and repeated ids each keep their row; other columns are not read. An empty table gives an empty result.
    Overlaps are spliced at the first common place, and any of them gives the same count.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    out = StructType([rows.schema["doc_id"], rows.schema["n_bytes"], StructField("n_tokens", LongType())])
    short = rows.where(F.col("n_bytes") <= huge).mapInArrow(_count_short(path), out)
    long_ = numbered(rows.where(F.col("n_bytes") > huge), "rid")
    counted = count_long(long_.select("rid", F.encode("text", "UTF-8").alias("bytes")), path, chunk, overlap)
    return short.union(long_.join(counted, "rid").select("doc_id", "n_bytes", "n_tokens"))
