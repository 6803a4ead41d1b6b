"""Exact dedup by deterministic block naming (native).

Texts are cut into fixed-size byte blocks. Sorting the distinct blocks gives each
an integer name; adjacent names are then paired and the distinct pairs sorted and
named again, level by level, until each document is one integer. Two documents of
the same level and name are byte-equal after lower-casing A-Z, and only those.

Blocks travel as two 64-bit hashes. Contents behind equal hashes are compared
over the whole corpus before the hashes may stand for them; on a collision the
blocks are hashed again with another seed, so names are free of collisions. A
block or a text may stand in any share of all rows: rows of one name are dealt
into parts for every join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpoint, join_groups, join_hot, name_by_sort, pick, write_table

BLOCK_BYTES = 4096


def _blocks(block_bytes: int, seed: int):
    """Array of (h1, h2, block) of column ``norm``; an empty text is one empty block."""
    body = F.col("norm").cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("norm") / F.lit(float(block_bytes)))).cast("int")

    def one(i):
        block = F.substring(body, i * block_bytes + 1, F.lit(block_bytes))
        return F.struct(F.xxhash64(F.lit(seed), block).alias("h1"), F.xxhash64(block, F.lit(seed + 1)).alias("h2"), block.alias("block"))

    return F.transform(F.sequence(F.lit(0), n - 1), one)


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and all empty texts are equal. Of equal texts the
    row with the largest doc_id stays (null ids lose); of rows that repeat that
    id too, one stays. An empty table gives an empty result.
    """
    norm = pick(docs, doc_id="doc_id", text="text").select("doc_id", ascii_lower(F.col("text")).alias("norm"))
    seed = 0
    while True:
        blocks = norm.select(F.explode(_blocks(block_bytes, seed)).alias("b")).select("b.*")
        contents = blocks.groupBy("h1", "h2", "block").agg(F.lit(1).alias("one"))
        clash = contents.groupBy("h1", "h2").count().where("count > 1").limit(1).count()
        if not clash:
            break
        seed += 2
    rows = write_table(
        norm.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.sha2("norm", 256).alias("text_sha256"),
            F.transform(_blocks(block_bytes, seed), lambda b: F.struct(b["h1"].alias("h1"), b["h2"].alias("h2"))).alias("hs"),
        ),
        "exact_rows",
    )
    flat = rows.select("row", F.size("hs").alias("left"), F.posexplode("hs").alias("pos", "h")).select("row", "left", "pos", "h.h1", "h.h2")
    names = name_by_sort(flat, "h1", "h2")
    current = join_hot(flat, ["h1", "h2"], "row", names).select("row", "left", "pos", "name")
    longest = rows.agg(F.max(F.size("hs"))).first()[0] or 1
    done, level = [], 0
    while True:
        done.append(current.where("left = 1").select("row", F.lit(level).alias("level"), "name"))
        if longest <= 1:
            break
        rest = current.where("left > 1")
        pairs = rest.groupBy("row", "left", F.expr("pos div 2").alias("at")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = checkpoint(pairs)
        names = name_by_sort(pairs, "a", "b")
        current = join_hot(pairs, ["a", "b"], "row", names).select("row", F.expr("cast((left + 1) div 2 as int)").alias("left"), F.col("at").alias("pos"), "name")
        longest, level = (longest + 1) // 2, level + 1
    identity = done[0]
    for part in done[1:]:
        identity = identity.unionByName(part)
    named = checkpoint(rows.select("row", "doc_id", "text_sha256").join(identity, "row"))
    best = F.max(F.struct("doc_id", (-F.col("row")).alias("r"))).alias("keep")
    grouped = join_groups(named, ["level", "name"], "row", [best, F.count(F.lit(1)).alias("group_size")], [F.max("keep").alias("keep"), F.sum("group_size").alias("group_size")])
    return grouped.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == -F.col("keep.r")).alias("kept"),
        "text_sha256",
    )
