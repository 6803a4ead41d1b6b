"""Budgets: round robin over buckets, caps, first-come limits. What is dropped is kept as a row with a reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RetrievalPolicy:
    """The budgets of a retrieval."""

    max_issues: int = 8
    max_queries_per_issue: int = 4
    max_candidates_per_role: int = 5
    global_candidate_cap: int = 80
    max_selected_evidence: int = 40
    max_source_elements_per_clause: int = 5
    reference_depth: int = 2
    max_reference_nodes: int = 12
    max_reference_fanout: int = 6


def requests_for_issues(requests: DataFrame, policy: RetrievalPolicy = RetrievalPolicy()) -> DataFrame:
    """issue, role, request plus place and selected: roles take turns until the issue's budget is used.

    ``requests`` has issue, role, role_pos, request, ord.
    """
    depth = Window.partitionBy("issue", "role").orderBy("ord", "request")
    turns = requests.withColumn("depth", F.row_number().over(depth))
    place = Window.partitionBy("issue").orderBy("depth", "role_pos")
    placed = turns.withColumn("place", F.row_number().over(place))
    return placed.withColumn("selected", F.col("place") <= policy.max_queries_per_issue).withColumn("reason", F.when(~F.col("selected"), "QUERY_BUDGET"))


def interleave(candidates: DataFrame, group: list[str], cap: int) -> DataFrame:
    """Rank-major interleave of buckets: first place of each item, ``selected`` up to ``cap`` items per group.

    ``candidates`` has the group columns, bucket, rank and item.
    """
    first = Window.partitionBy(*group, "item").orderBy("rank", "bucket")
    once = candidates.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    place = Window.partitionBy(*group).orderBy("rank", "bucket", "item")
    return once.withColumn("place", F.row_number().over(place)).withColumn("selected", F.col("place") <= cap)


def first_come(pairs: DataFrame, group: list[str], cap: int) -> DataFrame:
    """Evidence in the order of its candidates: each once, ``cap`` per group. ``pairs`` has candidate order ``ord`` and ``evidence``."""
    once = pairs.groupBy(*group, "evidence").agg(F.min("ord").alias("ord"))
    place = Window.partitionBy(*group).orderBy("ord", "evidence")
    return once.withColumn("place", F.row_number().over(place)).where(F.col("place") <= cap)


def top_per_group(df: DataFrame, group: list[str], order: list, k: int, place: str = "place") -> DataFrame:
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(place) <= k)
