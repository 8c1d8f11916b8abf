"""Exact deduplication by deterministic block naming, in DataFrame operations only.

Texts are cut into blocks of a fixed number of bytes. Equal blocks get the same integer name: the
distinct blocks of each partition are sorted and numbered in that order. Adjacent pairs of names are sorted and named in
turn until each document has one name. Names are given to the contents themselves, never to hashes, so
two documents share an identity exactly if their texts are equal.

A document whose byte length and first ``seed`` bytes occur once is settled by that seed alone: no other
text can equal it. Only documents that share their seed are cut into blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import numbered, written

BLOCK = 1024
SEED = 64


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ``keys`` with an integer ``name``: equal ones meet in one partition, where they are sorted and numbered."""
    # The partitions of the distinct step are kept, so contents move once and none goes to the driver.
    # The table is written because the numbers may differ when it is computed again.
    return numbered(distinct.sortWithinPartitions(*keys), "name")


def block_names(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Collision-free identities of ``texts`` (``rid`` long, ``bytes`` binary).

    Returns ``rid, identity``; two rows have the same identity exactly if their bytes are equal, given
    that their lengths are equal. Empty bytes are one empty block.
    """
    pieces = F.transform(
        F.sequence(F.lit(0).cast("long"), F.floor((F.greatest(F.octet_length("bytes"), F.lit(1)) - 1) / block)),
        lambda i: F.struct(i.alias("pos"), F.substring(F.col("bytes"), (i * block + 1).cast("int"), F.lit(block)).alias("block")),
    )
    blocks = texts.select("rid", F.explode(pieces).alias("p")).select("rid", "p.pos", "p.block")
    names = _named(blocks.select("block").distinct(), ["block"])
    level = written(blocks.join(names, "block").select("rid", "pos", "name"))
    while level.where("pos > 0").limit(1).count():
        halves = level.groupBy("rid", F.expr("pos div 2").alias("pos")).agg(
            F.min(F.struct("pos", "name"))["name"].alias("left"),
            F.when(F.count("*") == 2, F.max(F.struct("pos", "name"))["name"]).otherwise(F.lit(-1)).alias("right"),
        )
        names = _named(halves.select("left", "right").distinct(), ["left", "right"])
        level = written(halves.join(names, ["left", "right"]).select("rid", "pos", "name"))
    return level.select("rid", F.col("name").alias("identity"))


def _groups(rows: DataFrame, id_col: str, text_col: str, block: int, seed: int) -> DataFrame:
    """``rid, last (id, rid), size`` of the rows that have equal ones; ``rows`` has ``__rid``."""
    raw = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    keyed = rows.select(F.col("__rid").alias("rid"), F.col(id_col).alias("id"), raw.alias("bytes"))
    keyed = keyed.withColumn("n", F.octet_length("bytes")).withColumn("head", F.substring("bytes", 1, seed))
    shared = keyed.groupBy("n", "head").count().where("count > 1").select("n", "head")
    texts = written(keyed.join(shared, ["n", "head"]).select("rid", "id", "n", "bytes"))
    ids = texts.select("rid", "id", "n").join(block_names(texts.select("rid", "bytes"), block), "rid")
    groups = ids.groupBy("n", "identity").agg(F.max(F.struct("id", "rid")).alias("last"), F.count("*").alias("size")).where("size > 1")
    return written(ids.join(groups, ["n", "identity"]).select("rid", "last", "size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, seed: int = SEED, carry: dict | None = None) -> DataFrame:
    """``docs`` with the group of equal texts of each row.

    Adds ``keep_id`` (largest id of the group), ``group_size`` and ``kept`` (true for one row of each
    group: that with the largest id; among rows that repeat the same id, the last one read). A null text
    counts as empty; a null id is smaller than any other. Other columns pass through unless they have
    these three names, which are replaced. With ``carry`` (names and expressions) only these columns
    stand beside the three, which spares moving the texts. An empty table gives an empty result. A text of any
    length is compared whole, cut into blocks that are spread over tasks.
    """
    rows = numbered(docs.drop("keep_id", "group_size", "kept"), "__rid")
    copies = _groups(rows, id_col, text_col, block, seed).select(F.col("rid").alias("__rid"), F.struct("last", "size").alias("__group"))
    chosen = [F.col(f"`{c}`") for c in rows.columns if c != "__rid"] if carry is None else [e.alias(c) for c, e in carry.items()]
    found = rows.select(*chosen, "__rid", F.col(id_col).alias("__id")).join(copies, "__rid", "left")
    return found.select(
        *[F.col(f"`{c}`") for c in found.columns if c not in ("__rid", "__id", "__group")],
        F.when(F.col("__group").isNotNull(), F.col("__group.last.id")).otherwise(F.col("__id")).alias("keep_id"),
        F.coalesce(F.col("__group.size"), F.lit(1)).alias("group_size"),
        (F.col("__group").isNull() | (F.col("__group.last.rid") == F.col("__rid"))).alias("kept"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row of each group of equal texts (that with the largest id), with the columns of ``docs``."""
    rows = numbered(docs, "__rid")
    dropped = _groups(rows, id_col, text_col, block, seed).where("last.rid <> rid").select(F.col("rid").alias("__rid"))
    return rows.join(dropped, "__rid", "left_anti").drop("__rid")
