"""Decisions over evidence: coverage, confidence, gates, readiness, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Gates in their order, and the score below which a result abstains.
GATES = {
    "missing_required_input": "MISSING_REQUIRED_INPUT", "uncited_or_unresolved_claim": "UNCITED_OR_UNRESOLVED_CLAIM", "unapproved_rule": "UNAPPROVED_RULE",
    "math_engine_error": "MATH_ENGINE_ERROR", "source_hash_mismatch": "SOURCE_HASH_MISMATCH", "unresolved_conflict": "UNRESOLVED_CONFLICT",
    "track_b_rejection": "TRACK_B_REJECTION", "machine_set_human_decision": "MACHINE_SET_HUMAN_DECISION", "unregistered_numeric_value": "UNREGISTERED_NUMERIC_VALUE",
}
LOW, HIGH = 0.70, 0.90
#: Weights of the confidence factors, sum 1.
FACTOR_WEIGHTS = {
    "source completeness": "0.20", "traceability": "0.15", "parse quality": "0.10", "human review status": "0.10", "rule coverage": "0.15",
    "input completeness": "0.15", "calculation validity": "0.05", "Track B agreement": "0.05", "source freshness": "0.03", "unresolved conflict factor": "0.02",
}
#: Order of gap codes and of blockers.
GAP_ORDER = ["CONFLICTING_RULES", "AMBIGUOUS_RULE", "SOURCE_NOT_INGESTED", "REFERENCE_TARGET_MISSING", "PARSE_GAP", "MISSING_REQUIRED_FACET", "RELEVANCE_INSUFFICIENT", "RETRIEVAL_MISS"]
BLOCKERS = ["SOURCE_CONFLICT", "SOURCE_HASH_MISMATCH", "STALE_SNAPSHOT", "UNAPPROVED_RULE", "MISSING_FORMULA", "MISSING_REQUIRED_INPUT"]


def codes(*pairs: tuple[Column, str]) -> Column:
    """Array of the codes whose condition is true, in the given order."""
    return F.filter(F.array(*[F.when(c, F.lit(code)) for c, code in pairs]), lambda x: x.isNotNull())


def in_order(col: Column, order: list[str]) -> Column:
    """Distinct values in the order of a list; unknown ones go."""
    return F.filter(F.array(*[F.lit(x) for x in order]), lambda x: F.array_contains(col, x))


def abstention_reasons(score: Column, flags: dict[str, Column]) -> Column:
    """Reasons of all gates that are up, then LOW_CONFIDENCE."""
    pairs = [(flags[name], code) for name, code in GATES.items() if name in flags]
    return codes(*pairs, (score < LOW, "LOW_CONFIDENCE"))


def confidence(factors: DataFrame, key: str) -> DataFrame:
    """key, score, level from (key, name, value, source): exact weighted sum, all ten factors needed.

    ``factors`` may hold ``failures`` (number of hard failures of the key).
    """
    rows = [(k, v) for k, v in FACTOR_WEIGHTS.items()]
    weights = factors.sparkSession.createDataFrame(rows, "name string, weight string").withColumn("weight", F.col("weight").cast("decimal(4,2)"))
    joined = factors.join(F.broadcast(weights), "name", "left")
    total = joined.groupBy(key).agg(
        F.sum(F.col("value").cast("decimal(10,4)") * F.col("weight")).alias("exact"),
        F.count_distinct("name").alias("n"),
        F.count_if(F.col("weight").isNull()).alias("unknown"),
        F.max("failures").alias("failures"),
        F.bool_or((F.col("name") == "human review status") & (F.col("source") == "human_review:pending")).alias("pending"),
    )
    wrong = (F.col("n") != len(FACTOR_WEIGHTS)) | (F.col("unknown") > 0)
    score = F.when(wrong, F.raise_error("confidence factors are missing or unknown").cast("decimal(10,4)")).otherwise(F.round("exact", 4).cast("decimal(10,4)"))
    scored = total.select(key, score.alias("score"), "failures", "pending")
    level = F.when((F.col("failures") > 0) | (F.col("score") < LOW), "LOW").when(F.col("pending"), "MEDIUM").when(F.col("score") >= HIGH, "HIGH").otherwise("MEDIUM")
    return scored.select(key, "score", level.alias("level"))


def issue_coverage(issues: DataFrame) -> DataFrame:
    """Adds covered, missing, status and gaps to issues.

    Needs arrays required, semantic (roles with a candidate), cited (roles with
    citable evidence) and missing_facets, and booleans conflicting, ambiguous,
    source_missing, reference_missing, relevance_insufficient, conditional.
    Precedence: conflict, ambiguity, source, relevance, parse gap or retrieval
    miss, facet, conditional, resolved.
    """
    c = F.col
    covered, missing = F.array_sort(F.array_intersect("required", "cited")), F.array_sort(F.array_except("required", "cited"))
    source = c("source_missing") | c("reference_missing")
    parse = F.arrays_overlap(missing, F.col("semantic"))
    clear = ~c("conflicting") & ~c("ambiguous")
    open_ = clear & ~source & ~c("relevance_insufficient")
    status = (
        F.when(c("conflicting"), "CONFLICT").when(c("ambiguous"), "UNRESOLVED").when(source, "SOURCE_MISSING").when(c("relevance_insufficient"), "UNRESOLVED")
        .when((F.size(missing) > 0) | (F.size("missing_facets") > 0), "UNRESOLVED").when(c("conditional"), "CONDITIONAL").otherwise("RESOLVED")
    )
    gaps = codes(
        (c("conflicting"), "CONFLICTING_RULES"), (~c("conflicting") & c("ambiguous"), "AMBIGUOUS_RULE"), (clear & c("source_missing"), "SOURCE_NOT_INGESTED"),
        (clear & c("reference_missing"), "REFERENCE_TARGET_MISSING"), (open_ & (F.size(missing) > 0) & parse, "PARSE_GAP"),
        (open_ & (F.size(missing) == 0) & (F.size("missing_facets") > 0), "MISSING_REQUIRED_FACET"), (clear & c("relevance_insufficient"), "RELEVANCE_INSUFFICIENT"),
        (open_ & (F.size(missing) > 0) & ~parse, "RETRIEVAL_MISS"),
    )
    return issues.withColumns({"covered": covered, "missing": missing, "status": status, "gaps": gaps})


def coverage_factors(covered: DataFrame, key: str) -> DataFrame:
    """Per key seven ratio factors over its issues, four digits, half up."""
    complete = F.col("status").isin("RESOLVED", "CONDITIONAL")
    n = F.count(F.lit(1))

    def ratio(part: Column, whole: Column) -> Column:
        return F.round(part.cast("decimal(18,0)") / F.nullif(whole, F.lit(0)).cast("decimal(18,0)"), 4).cast("decimal(10,4)")

    no_source_gap = ~F.arrays_overlap("gaps", F.array(F.lit("SOURCE_NOT_INGESTED"), F.lit("REFERENCE_TARGET_MISSING"), F.lit("RETRIEVAL_MISS")))
    roles = F.size("covered") + F.size("missing")
    return covered.groupBy(key).agg(
        ratio(F.count_if(no_source_gap), n).alias("source_completeness"),
        ratio(F.count_if(complete & (F.size("covered") > 0) & (F.size("missing") == 0)), n).alias("traceability"),
        ratio(F.sum(F.size("covered")), F.sum(roles)).alias("rule_coverage"),
        ratio(F.count_if(complete & (F.size("missing") == 0)), n).alias("input_completeness"),
        ratio(F.count_if(~F.array_contains("gaps", "PARSE_GAP")), n).alias("parse_quality"),
        F.when(F.count_if(F.col("status") == "CONFLICT") > 0, 0).otherwise(1).alias("no_conflict"),
        F.count_if(complete).alias("n_resolved"),
        n.alias("n_issues"),
    )


def global_abstain(issues: DataFrame, key: str) -> DataFrame:
    """key, partial (some but not all resolved), abstain (none resolved)."""
    ok = F.col("status").isin("RESOLVED", "CONDITIONAL")
    return issues.groupBy(key).agg((F.bool_or(ok) & ~F.bool_and(ok)).alias("partial"), (~F.bool_or(ok)).alias("abstain"))


def source_state(role: Column, declared: Column, available: Column, supported: Column, ingested: Column, confirm: Column, valid: Column) -> Column:
    """State of a source from its role and flags."""
    return (
        F.when(~valid, "FAILED").when((role == "CASE_DRAWING") & confirm, "INPUT_CONFIRMATION_REQUIRED").when(role == "CASE_DRAWING", "PENDING_DRAWING_INGESTION")
        .when(role == "SUPPORTING_IMAGE", "BLOCKED").when(~declared | ~available, "PENDING_PARSER_OUTPUT").when(~supported, "BLOCKED")
        .when(ingested, "READY_TO_EVALUATE").otherwise("PENDING_REFERENCE_INGESTION")
    )


def review_readiness(attachments: DataFrame, key: str) -> DataFrame:
    """key, state, pending ids: the first gate in fixed order that has anything pending.

    ``attachments`` has attachment, role and state (see source_state); a missing
    state stands for a missing fact.
    """
    def ids(cond: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(cond, F.col("attachment"))))

    s = F.col("state")
    gathered = attachments.groupBy(key).agg(
        ids(F.col("role").isNull()).alias("roles"),
        ids(s.isin("PENDING_PARSER_OUTPUT", "PENDING_REFERENCE_INGESTION")).alias("refs"),
        ids(s == "PENDING_DRAWING_INGESTION").alias("drawings"),
        ids(s == "INPUT_CONFIRMATION_REQUIRED").alias("confirms"),
        F.bool_or(F.col("role").isNotNull() & (F.col("role") != "SUPPORTING_IMAGE") & (s.isNull() | s.isin("BLOCKED", "FAILED"))).alias("missing"),
    )
    ladder = [("ROLE_CONFIRMATION_REQUIRED", "roles"), ("PENDING_REFERENCE_INGESTION", "refs"), ("PENDING_DRAWING_INGESTION", "drawings"), ("INPUT_CONFIRMATION_REQUIRED", "confirms")]
    state, pending = F.when(F.coalesce("missing", F.lit(False)), "BLOCKED").otherwise("READY_TO_EVALUATE"), F.array().cast("array<string>")
    for name, col in reversed(ladder):
        state = F.when(F.size(col) > 0, name).otherwise(state)
        pending = F.when(F.size(col) > 0, F.col(col).cast("array<string>")).otherwise(pending)
    return gathered.select(key, state.alias("state"), pending.alias("pending"))
