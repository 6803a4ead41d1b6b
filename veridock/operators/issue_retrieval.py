"""Issue-aware retrieval: many plans, their issues and requests in one job, within budgets, with a reason for every drop.

Requests of an issue take turns by role until its budget is used. Those selected
fall through the stages over the stored index. Candidates of each (issue, role) are
merged and cut; a plan's buckets are then interleaved rank by rank up to its cap,
and evidence is materialised in that order up to a cap of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridock.operators.budgets import RetrievalPolicy, requests_for_issues
from veridock.operators.cascade import fall_through
from veridock.operators.inverted_index import Index
from veridock.sources.session import ensure_checkpoint_dir

#: Why a request or a candidate was dropped.
QUERY_BUDGET, CANDIDATE_BUDGET = "QUERY_BUDGET", "CANDIDATE_BUDGET"


@dataclass
class IssueBundle:
    """candidates (plan, place, key, score, matches), evidence (plan, place, evidence), budget_limited (plan, key), drops (plan, issue, request, reason, key), trace (plan, issue, role, request, ord, stage, derived, hit_count)."""

    candidates: DataFrame
    evidence: DataFrame
    budget_limited: DataFrame
    drops: DataFrame
    trace: DataFrame


def bucketed(hits: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """plan, bucket, issue, key, score, matches, rank: the best candidates of each (issue, role), merged by key.

    ``asked`` has plan, issue, issue_pos, role, role_pos, request; a bucket is its
    (issue_pos, role_pos). A key that several requests found has its best score and
    all its matches.
    """
    found = hits.join(asked.withColumnRenamed("request", "q"), "q")
    match = F.struct(F.col("q").alias("request"), "issue", "role", "derived", "stage")
    bucket = F.struct("issue_pos", "role_pos").alias("bucket")
    merged = found.groupBy("plan", "issue", bucket, "key").agg(F.max("score").alias("score"), F.array_sort(F.collect_set(match)).alias("matches"))
    order = Window.partitionBy("plan", "bucket").orderBy(F.desc("score"), "key")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def interleaved(buckets: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """Selected candidates (plan, place, key, score, matches), and drops of those beyond the cap, one per match of each bucket.

    A plan has at most issues x roles x limit rows here, so its window is small.
    """
    # The place of a key is that of its first appearance, rank by rank, bucket by bucket.
    first = buckets.groupBy("plan", "key").agg(F.min(F.struct("rank", "bucket")).alias("first"), F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("matches")))).alias("matches"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("plan").orderBy("first")))
    chosen = placed.where(F.col("place") <= cap).select("plan", "place", "key", "score", "matches")
    lost = buckets.join(placed.where(F.col("place") > cap).select("plan", "key"), ["plan", "key"]).select("plan", F.explode("matches").alias("m"), "key")
    return chosen, lost.select("plan", "m.issue", "m.request", F.lit(CANDIDATE_BUDGET).alias("reason"), "key").distinct()


def materialized(chosen: DataFrame, elements: DataFrame, policy: RetrievalPolicy) -> tuple[DataFrame, DataFrame]:
    """Evidence (plan, place, evidence) of the candidates in order, each once, up to the cap; and the candidates (plan, key) that lost some of theirs to it.

    ``elements`` (key, ord, evidence) are a candidate's own elements in order, of which
    the first few count.
    """
    own = Window.partitionBy("key").orderBy("ord", "evidence")
    # Only what was chosen is put in order.
    few = elements.join(chosen.select("key").distinct(), "key", "left_semi").withColumn("n", F.row_number().over(own)).where(F.col("n") <= policy.max_source_elements_per_clause)
    listed = chosen.join(few, "key").select("plan", "key", F.struct("place", "n").alias("at"), "evidence")
    first = listed.groupBy("plan", "evidence").agg(F.min("at").alias("at"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("plan").orderBy("at")))
    kept = placed.where(F.col("place") <= policy.max_selected_evidence).select("plan", "place", "evidence")
    limited = listed.join(kept, ["plan", "evidence"], "left_anti").select("plan", "key").distinct()
    return kept, limited


def retrieve(index: Index, requests: DataFrame, elements: DataFrame, policy: RetrievalPolicy = RetrievalPolicy(), facts: DataFrame | None = None, labels: DataFrame | None = None, headings: DataFrame | None = None, accept: Callable[[DataFrame], DataFrame] | None = None) -> IssueBundle:
    """The bundles of all plans.

    ``requests``: plan, issue (distinct over all plans), issue_pos, role, role_pos,
    request (distinct), ord, text. ``facts``: plan, facts (texts). ``elements``: key,
    ord, evidence. A plan with more issues than the policy allows is an error. ``accept``
    gets (request as q, key) and returns what is relevant.
    """
    ensure_checkpoint_dir(requests.sparkSession)
    many = requests.groupBy("plan").agg(F.count_distinct("issue").alias("n")).where(F.col("n") > policy.max_issues).first()
    if many:
        raise ValueError(f"plan {many['plan']} has {many['n']} issues, more than {policy.max_issues}")
    placed = requests_for_issues(requests, policy).checkpoint()
    asked = placed.where("selected")
    known = facts if facts is not None else requests.select("plan").distinct().select("plan", F.array().cast("array<string>").alias("facts"))
    queries = asked.join(known, "plan", "left").select(F.col("request").alias("q"), "text", "facts")
    hits, trace = fall_through(index, queries, policy.max_candidates_per_role, labels, headings, accept)
    buckets = bucketed(hits, asked, policy.max_candidates_per_role).checkpoint()
    chosen, lost = interleaved(buckets, policy.global_candidate_cap)
    evidence, limited = materialized(chosen, elements, policy)
    unasked = placed.where("NOT selected").select("plan", "issue", "request", F.lit(QUERY_BUDGET).alias("reason"), F.lit(None).cast(chosen.schema["key"].dataType).alias("key"))
    about = asked.select("plan", "issue", "role", F.col("request").alias("q"))
    traced = trace.join(about, "q").select("plan", "issue", "role", F.col("q").alias("request"), "ord", "stage", "derived", "hit_count")
    return IssueBundle(chosen, evidence, limited, unasked.unionByName(lost), traced)


def trace_documents(bundle: IssueBundle) -> DataFrame:
    """One row per plan: its requests with attempts, candidates, evidence and drops, as arrays in order."""
    steps = bundle.trace.groupBy("plan", "issue", "role", "request").agg(F.array_sort(F.collect_list(F.struct("ord", "stage", "derived", "hit_count"))).alias("attempts"))
    tried = steps.groupBy("plan").agg(F.array_sort(F.collect_list(F.struct("issue", "role", "request", "attempts"))).alias("requests"))
    found = bundle.candidates.groupBy("plan").agg(F.array_sort(F.collect_list(F.struct("place", "key", "score", "matches"))).alias("candidates"))
    held = bundle.evidence.groupBy("plan").agg(F.array_sort(F.collect_list(F.struct("place", "evidence"))).alias("evidence"))
    lost = bundle.drops.groupBy("plan").agg(F.array_sort(F.collect_list(F.struct("issue", "request", "reason", "key"))).alias("drops"))
    return tried.join(found, "plan", "full").join(held, "plan", "full").join(lost, "plan", "full")
