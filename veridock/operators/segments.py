"""Ordered rows into segments: carry-forward sections, siblings, ordinals, anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridock.functions.text import heading_slug
from veridock.operators.ranks import group_ranks


def segment(df: DataFrame, group: list[str], order: str, starts: Column) -> DataFrame:
    """Adds ``segment``: 0 before the first start of a group, then 1, 2, ... from each start on."""
    return df.withColumn("segment", F.sum(starts.cast("int")).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def fold_segments(df: DataFrame, group: list[str], order: str, text: str) -> DataFrame:
    """One row per segment: its text in order, first and last place, number of rows."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(*group, "segment").agg(
        F.array_join(F.transform(pieces, lambda p: p["t"]), "\n").alias("text"), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n_rows")
    )


def siblings(df: DataFrame, group: list[str], order: str, key: str) -> DataFrame:
    """source, target, relation: links to the next and to the previous row of a group. Neighbours meet by their place, so a large group is no single task."""
    placed = group_ranks(df.select(*dict.fromkeys([*group, order, key])), group, list(dict.fromkeys([order, key])))
    names = [f"__g{k}" for k in range(len(group))]
    after = placed.select(*[F.col(g).alias(n) for g, n in zip(group, names, strict=True)], (F.col("rank") - 1).alias("__before"), F.col(key).alias("__next"))
    pairs = placed.join(after, [*[F.col(g).eqNullSafe(F.col(n)) for g, n in zip(group, names, strict=True)], F.col("rank") == F.col("__before")]).select(F.col(key).alias("a"), F.col("__next").alias("b"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("next_sibling").alias("relation")), F.struct(F.col("b").alias("source"), F.col("a").alias("target"), F.lit("previous_sibling").alias("relation"))))
    return pairs.select(both.alias("l")).select("l.*")


def ordinal(df: DataFrame, group: list[str], order: list, name: str = "ordinal") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def heading_anchors(df: DataFrame, group: list[str], order: str, heading: str) -> DataFrame:
    """Adds ``anchor``: the slug, and -1, -2, ... for repeats within a group."""
    base = group_ranks(df.withColumn("__slug", heading_slug(F.col(heading))), [*group, "__slug"], [order], "__n")
    n = F.col("__n") - 1
    return base.withColumn("anchor", F.when(n > 0, F.concat_ws("-", "__slug", n.cast("string"))).otherwise(F.col("__slug"))).drop("__slug", "__n")
