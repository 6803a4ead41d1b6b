"""Checks of claims and audits, merged search terms, matters, calibrations: joins, groups and windows over their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridock.functions.numbers import numeric_texts, relation_holds

#: Origins of a search term, the most trusted first.
ORIGINS = ("primary", "approved_synonym", "user", "llm")
#: Dispositions of an audited claim.
DISPOSITIONS = ("ACCEPT", "REVISE", "REJECT")
#: States of a drawing workflow, the first whose flag is set.
DRAWING_STATES = ("FAILED", "BLOCKED", "AWAITING_CONFIRMATION", "READY_TO_EVALUATE")


def gate_status(disposition: Column, responsiveness: Column, completeness: Column) -> Column:
    """PASS, FAILED or NOT_VERIFIED of an audit; what is null isn't verified."""
    failed = F.coalesce(disposition == "REJECT", F.lit(False)) | F.coalesce(responsiveness == "FAIL", F.lit(False))
    passed = (disposition == "ACCEPT") & (responsiveness == "PASS") & completeness.isin("COMPLETE", "NOT_APPLICABLE")
    return F.when(failed, "FAILED").when(passed, "PASS").otherwise("NOT_VERIFIED")


def facet_coverage(required: DataFrame, support: DataFrame) -> DataFrame:
    """issue, covered, missing: facets of required(issue, facet) that support(issue, facet, evidence) holds evidence for, and the rest."""
    held = support.where("evidence IS NOT NULL").select("issue", "facet", F.lit(True).alias("held")).distinct()
    joined = required.select("issue", "facet").distinct().join(held, ["issue", "facet"], "left")

    def facets(condition: Column, name: str) -> Column:
        return F.array_sort(F.collect_set(F.when(condition, F.col("facet")))).alias(name)

    return joined.groupBy("issue").agg(facets(F.col("held").isNotNull(), "covered"), facets(F.col("held").isNull(), "missing"))


def facet_completeness(runs: DataFrame, required: DataFrame, claims: DataFrame, accepted: DataFrame) -> DataFrame:
    """run, completeness of runs(run): whether accepted, cited claims fulfil all facets their run requires.

    required(run, facet), claims(run, claim, facet, cited), accepted(claim).
    """
    done = claims.where("cited").join(accepted.select("claim").distinct(), "claim", "left_semi").select("run", "facet", F.lit(True).alias("done")).distinct()
    states = required.select("run", "facet").distinct().join(done, ["run", "facet"], "left").groupBy("run").agg(F.bool_and(F.col("done").isNotNull()).alias("every"))
    state = F.when(F.col("every").isNull(), "NOT_APPLICABLE").when(F.col("every"), "COMPLETE").otherwise("INCOMPLETE")
    return runs.select("run").join(states, "run", "left").select("run", state.alias("completeness"))


def unsupported_numbers(claims: DataFrame, citations: DataFrame, sources: DataFrame) -> DataFrame:
    """claim, number: numbers of claims(claim, text) that stand in none of the texts they cite.

    citations(claim, source), sources(source, text). Numbers are compared as written.
    """

    def found(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, F.explode(F.array_distinct(numeric_texts(F.col("text")))).alias("number"))

    # Texts are read once each, however many claims cite them.
    cited = citations.select("claim", "source").distinct().join(found(sources, "source"), "source").select("claim", "number")
    return found(claims, "claim").join(cited, ["claim", "number"], "left_anti")


def audit_errors(claims: DataFrame, audits: DataFrame) -> DataFrame:
    """claim, code: claims without exactly one audit, audits of no claim, unknown dispositions."""
    counts = audits.groupBy("claim").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(F.col("disposition").isin(*DISPOSITIONS), F.lit(False))).alias("known"))
    both = claims.select("claim", F.lit(True).alias("is_claim")).distinct().join(counts, "claim", "full")
    code = (
        F.when(F.col("n").isNull(), "AUDIT_MISSING").when(F.col("is_claim").isNull(), "UNKNOWN_CLAIM")
        .when(F.col("n") > 1, "AUDIT_DUPLICATE").when(~F.col("known"), "UNKNOWN_DISPOSITION")
    )
    return both.select("claim", code.alias("code")).where("code IS NOT NULL")


def comparison_state(left: Column, operator: Column, right: Column, recorded: Column) -> Column:
    """CONFIRMED if the recorded truth of a comparison is what its numbers give, WRONG_RESULT if not, UNKNOWN_OPERATOR."""
    holds = relation_holds(left, operator, right)
    return F.when(holds.isNull(), "UNKNOWN_OPERATOR").when(holds == recorded, "CONFIRMED").otherwise("WRONG_RESULT")


def merge_terms(terms: DataFrame) -> DataFrame:
    """text, origin, requests, issues, place of terms(text, origin, request, issue, ord): one row per text.

    The most trusted origin wins, but a primary text that a request brings too
    keeps that request's origin; requests and issues are united in order; place
    is the text's turn by first appearance.
    """
    rank = F.array_position(F.array(*map(F.lit, ORIGINS)), F.col("origin")).cast("int")
    asked = F.col("request").isNotNull()
    grouped = terms.groupBy("text").agg(
        F.min(F.struct(rank.alias("r"), "origin"))["origin"].alias("best"), F.min(F.when(asked, F.struct(rank.alias("r"), "origin")))["origin"].alias("asked"),
        F.array_sort(F.collect_set("request")).alias("requests"), F.array_sort(F.collect_set("issue")).alias("issues"), F.min("ord").alias("first"),
    )
    origin = F.when((F.col("best") == "primary") & F.col("asked").isNotNull(), F.col("asked")).otherwise(F.col("best"))
    return grouped.select("text", origin.alias("origin"), "requests", "issues", "first")


def merge_candidates(hits: DataFrame, keys: list[str], identity: list[str]) -> DataFrame:
    """One row per candidate: best score, channels and issues united; ``conflict`` where rows of a key differ in identity columns."""
    differ = F.count_distinct(F.struct(*identity)) > 1
    return hits.groupBy(*keys).agg(F.max("score").alias("score"), F.array_sort(F.collect_set("channel")).alias("channels"), F.array_sort(F.collect_set("issue")).alias("issues"), differ.alias("conflict"))


def nearest_sources(sources: DataFrame, group: str, phrase: Column, overlap: Column, relation: Column, order: Column, key: str, limit: int = 5) -> DataFrame:
    """The ``limit`` sources of each group that lie nearest: phrase hit, most overlap, relation, order, then id; ``place`` added."""
    w = Window.partitionBy(group).orderBy(F.desc(phrase), F.desc(overlap), relation, order, key)
    return sources.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def candidate_cap(limit: int) -> int:
    """How many candidates a search of ``limit`` results looks at."""
    return max(16 * limit, 100)


def ordered_drops(drops: DataFrame) -> DataFrame:
    """Drop records with their place in the fixed total order: issue, request, reason, clause, evidence; null as empty."""
    w = Window.partitionBy("issue").orderBy("request", "reason", F.coalesce("clause", F.lit("")), F.coalesce("evidence", F.lit("")))
    return drops.withColumn("place", F.row_number().over(w))


def matter_revision(events: DataFrame) -> DataFrame:
    """matter, revision, refused of events(matter, ord, expected): an event is taken if it expects the revision that it meets.

    A matter's events are folded in order; a matter is one case with a file's
    worth of events, so its list fits a row.
    """
    expected = F.transform(F.array_sort(F.collect_list(F.struct("ord", "expected"))), lambda x: x["expected"])
    folded = F.aggregate("es", F.lit(0).cast("long"), lambda r, e: F.when(e == r, r + 1).otherwise(r))
    lists = events.groupBy("matter").agg(expected.alias("es"))
    return lists.select("matter", folded.alias("revision"), (F.size("es") - folded).alias("refused"))


def external_waits(stages: DataFrame, run: str, start: str, finish: str) -> DataFrame:
    """Adds ``wait``: seconds from the latest finish of the run's earlier stages to this start, 0 at least; null for the first."""
    earlier = Window.partitionBy(run).orderBy(start, finish).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(finish).over(earlier)
    gap = F.unix_timestamp(F.col(start).cast("timestamp")) - F.unix_timestamp(last.cast("timestamp"))
    return stages.withColumn("wait", F.when(gap >= 0, gap).when(gap < 0, 0))


def binding_status(runs: DataFrame, decisions: DataFrame) -> DataFrame:
    """run, status of runs(run, packet): VALID if a decision(run, packet) is bound to the run's packet, STALE if only to others, else MISSING."""
    mine = decisions.select("run", F.col("packet").alias("decided"))
    found = runs.join(mine, "run", "left").groupBy("run").agg(F.bool_or(F.col("decided") == F.col("packet")).alias("valid"), F.count("decided").alias("n"))
    return found.select("run", F.when(F.col("valid"), "VALID").when(F.col("n") > 0, "STALE").otherwise("MISSING").alias("status"))


def calibration(references: DataFrame, tolerance: Column) -> DataFrame:
    """drawing, axis, scale, agrees of references(drawing, axis, pixels, real): mean real length a pixel, and if all references lie within the tolerance of it."""
    ratio = F.col("real") / F.col("pixels")
    usable = references.where("pixels > 0 AND real > 0").select("drawing", "axis", ratio.alias("ratio"))
    grouped = usable.groupBy("drawing", "axis").agg(F.avg("ratio").alias("scale"), F.min("ratio").alias("lo"), F.max("ratio").alias("hi"))
    agrees = (F.col("hi") <= F.col("scale") * (1 + tolerance)) & (F.col("lo") >= F.col("scale") * (1 - tolerance))
    return grouped.select("drawing", "axis", "scale", agrees.alias("agrees"))


def drawing_quality(pages: DataFrame, case: str, order: list[str], least_side: int, most_pixels: int, case_pixels: int) -> DataFrame:
    """Adds reasons (joined) and quality of pages with width and height: PASS, REVIEW or REJECTED; a case's pixels add up in order."""
    pixels = F.col("width").cast("long") * F.col("height")
    total = F.sum(pixels).over(Window.partitionBy(case).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    checks = [
        (F.least("width", "height") < least_side, "LOW_RESOLUTION"),
        (pixels > most_pixels, "TOO_MANY_PIXELS"),
        (F.col("total") > case_pixels, "CASE_PIXEL_LIMIT"),
    ]
    reasons = F.filter(F.array(*[F.when(c, F.lit(code)) for c, code in checks]), lambda x: x.isNotNull())
    judged = pages.withColumn("total", total).withColumn("list", reasons)
    quality = F.when(F.array_contains("list", "TOO_MANY_PIXELS") | F.array_contains("list", "CASE_PIXEL_LIMIT"), "REJECTED").when(F.size("list") > 0, "REVIEW").otherwise("PASS")
    return judged.withColumn("reasons", F.array_join("list", ",")).withColumn("quality", quality).drop("list", "total")


def drawing_state(flags: dict[str, Column]) -> Column:
    """The first state in fixed order whose flag is set, else RECEIVED."""
    out = F.lit("RECEIVED")
    for state in reversed(DRAWING_STATES):
        out = F.when(F.coalesce(flags.get(state, F.lit(False)), F.lit(False)), state).otherwise(out)
    return out


def conditional_issues(comparisons: DataFrame) -> DataFrame:
    """issue of comparisons(issue, normal, conditional): one fails its normal limit and meets its conditional one, and no other fails."""
    eased = ~F.col("normal") & F.col("conditional")
    return comparisons.groupBy("issue").agg(F.bool_or(eased).alias("any"), F.bool_and(F.col("normal") | eased).alias("every")).where("any AND every").select("issue")
