"""Sharding by histogram sort.

Rows are ordered by (key, id, row number). The cuts between shards are found by counting: each round sums the bytes
below probe boundaries over all partitions, keeps only the probe intervals that hold a wanted cut, and
divides these further, until every cut is within the tolerance of its target. Rows are then exchanged
once. The default key is a hash of the text, so rows of equal texts are neighbours and share a shard
unless their group alone is too large for the tolerance; then the group is cut between ids, and between
rows of one id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import numbered, written

DIGIT = 10
TOLERANCE = 0.01
#: Rows that one task numbers at a time, about.
BIN_ROWS = 4096


def _prefix(column: str, bits: int) -> Column:
    """The top ``bits`` of a long, order preserving."""
    return F.lit(0).cast("long") if bits == 0 else F.shiftright(column, 64 - bits)


def _counts(keyed: DataFrame, column: str, bits: int, inside: Column | None) -> list[tuple[int, int, int]]:
    """(prefix, bytes, rows) of each probe interval that has rows, in order: at most 2**DIGIT for each open interval."""
    rows = keyed if inside is None else keyed.where(inside)
    got = rows.groupBy(_prefix(column, bits).alias("p")).agg(F.sum("size").alias("b"), F.count("*").alias("c")).collect()
    return sorted((r["p"], r["b"], r["c"]) for r in got)


ORDER = ("key", "id", "row")


def find_cut_points(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int, int] | None]:
    """``shards - 1`` splitters (key, id, row); a row belongs to a shard below a splitter if it is smaller.

    ``keyed`` has long columns ``key, id, row, size`` without nulls. None stands for a cut above all rows.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    targets = [total * k / shards for k in range(1, shards)]
    slack = tolerance * total / shards
    cuts: list = [None] * len(targets)
    # An open cut: its probe interval (prefix and bits), the bytes below that, and the key and id that are settled.
    open_ = {i: (0, 0, 0, ()) for i in range(len(targets))} if total else {}
    while open_:
        for bits, bound in {(x[1], x[3]) for x in open_.values()}:
            mine = {i: x for i, x in open_.items() if (x[1], x[3]) == (bits, bound)}
            now = min(64, bits + DIGIT)
            column = ORDER[len(bound)]
            inside = _prefix(column, bits).isin(sorted({x[0] for x in mine.values()}))
            for c, v in zip(ORDER, bound, strict=False):
                inside &= F.col(c) == v
            found: dict[int, list] = {}
            for p, b, c in _counts(keyed, column, now, inside):
                found.setdefault(p >> (now - bits) if bits else 0, []).append((p, b, c))
            for i, (start, _, below, _) in mine.items():
                for p, b, c in found[start]:
                    if below + b > targets[i] or p == found[start][-1][0]:
                        break
                    below += b
                low, high = abs(targets[i] - below), abs(below + b - targets[i])
                if min(low, high) <= slack or c == 1 or (now == 64 and len(bound) == 2):
                    cuts[i] = _position(p if low <= high else p + 1, now, bound)
                    del open_[i]
                elif now == 64:
                    open_[i] = (0, 0, below, (*bound, p))  # one key (or id) holds the cut: go on between its ids (or rows)
                else:
                    open_[i] = (p, now, below, bound)
    return cuts


def _position(prefix: int, bits: int, bound: tuple[int, ...]) -> tuple[int, int, int] | None:
    """(key, id, row) of the first position whose prefix is at least this one."""
    value, least = prefix << (64 - bits), -(2**63)
    while value > 2**63 - 1:
        if not bound:
            return None
        *bound, value = bound
        value += 1
    return (*bound, value, *[least] * (2 - len(bound)))


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row.

    ``size`` is the UTF-8 bytes of the text plus 1, a null text has none, a very long one counts whole. Shards
    differ in bytes by the tolerance and at most one row, ties and repeated rows included; slots are gapless from 0 in each shard and follow the order of keys,
    but for groups of equal keys. A null id counts as the smallest long for the order and stays null in
    the result; repeated rows each get their slot, and other columns are not read. An empty table gives an empty result.
    """
    raw = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("key"),
    )
    keyed = numbered(keyed, "row")
    cuts = find_cut_points(keyed, shards, tolerance)
    place = F.struct(*ORDER)
    reached = [place >= F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(ORDER, c, strict=True)]) for c in cuts if c is not None]
    shard = reduce(lambda a, r: a + r.cast("int"), reached, F.lit(0))
    # Slots: rows are numbered inside small bins; exact counts of the bins give where each begins.
    n_rows = keyed.count()
    bits = min(20, max(DIGIT, (n_rows // BIN_ROWS).bit_length()))
    placed = keyed.withColumns({"shard": shard, "bin": _prefix("key", bits)})
    sizes = placed.groupBy("shard", "bin").agg(F.count("*").alias("c"))
    # A bin with one large group of equal keys is numbered in several parts.
    parts = sizes.select("shard", "bin", F.ceil(F.col("c") / BIN_ROWS).cast("long").alias("parts"))
    split = parts.where("parts > 1")
    placed = placed.join(F.broadcast(split), ["shard", "bin"], "left") if split.limit(10_001).count() <= 10_000 else placed.join(split, ["shard", "bin"], "left")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id", "row", F.lit(7)), F.coalesce("parts", F.lit(1))))
    counted = placed.groupBy("shard", "bin", "part").agg(F.count("*").alias("c"))
    before = Window.partitionBy("shard").orderBy("bin", "part").rowsBetween(Window.unboundedPreceding, -1)
    begins = written(counted.withColumn("begin", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c"))
    inside = Window.partitionBy("shard", "bin", "part").orderBy("key", "id", "row")
    counted_rows = placed.withColumn("r", F.row_number().over(inside) - 1)
    return counted_rows.join(begins, ["shard", "bin", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("begin") + F.col("r")).cast("long").alias("slot"))
