"""Places of rows in the order of their group, and digests in order, where a group may hold a third of the table.

A window would sort such a group in one task. Here rows are sorted into ranges;
a row's place is its place in its range and the number of rows of its group in
earlier ranges, which is one small row per group and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridock.sources.session import ensure_checkpoint_dir

#: Children of a node in the tree of an ordered digest.
FAN = 64


def group_ranks(df: DataFrame, group: list[str], order: list[str], rank: str = "rank", size: str | None = None) -> DataFrame:
    """Adds ``rank`` (from 1, in the order of the columns, nulls first) and, if named, the ``size`` of the group.

    Rows that agree in all of these columns get places of their own in no fixed order.
    The sorted rows are checkpointed, as places must not change when a task runs again.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ordered = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = ordered.withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    placed = placed.withColumn("__range", F.shiftright("__at", 33))
    sizes = placed.groupBy(*group, "__range").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    # One row per group and range.
    earlier = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    if size:
        sizes = sizes.withColumn(size, F.sum("__n").over(Window.partitionBy(*group)))
    keys = [*group, "__range"]
    sizes = sizes.withColumnsRenamed({c: f"__key{k}" for k, c in enumerate(keys)})
    joined = placed.join(sizes, [F.col(c).eqNullSafe(F.col(f"__key{k}")) for k, c in enumerate(keys)])
    place = (F.col("__at") - F.col("__first") + F.col("__before") + 1).alias(rank)
    return joined.select(*df.columns, place, *([size] if size else []))


def ordered_digest(df: DataFrame, order: list[str], text: Column) -> DataFrame:
    """n_rows, digest: SHA-256 of the rows' texts in order, as a tree.

    Leaves are the digests of the rows; a node is that of up to ``FAN`` digests of
    the level below, joined; the root is the one node of the last level. Neither the
    partitions nor the order of rows that agree in everything show in it. An empty
    table has the digest of nothing.
    """
    hashed = df.select(*order, F.sha2(F.coalesce(text, F.lit("")), 256).alias("h"))
    level = group_ranks(hashed.withColumn("__all", F.lit(0)), ["__all"], [*order, "h"]).select((F.col("rank") - 1).alias("i"), "h")
    n = n_rows = level.count()
    while n > 1:
        children = F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"])
        level = level.groupBy(F.expr(f"i div {FAN}").alias("i")).agg(F.sha2(F.array_join(children, ""), 256).alias("h"))
        n = -(-n // FAN)
    root = level.agg(F.max("h").alias("h"))
    return root.select(F.lit(n_rows).cast("long").alias("n_rows"), F.coalesce("h", F.sha2(F.lit(""), 256)).alias("digest"))
