"""Final packets of runs: derived from the run's pieces, compared with what is stored, and released only if everything agrees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridock.functions.canonical import canonical_json

#: States of a packet, the strictest first.
STATUS = ("ABSTAINED", "NEEDS_INPUT", "PARTIAL", "READY_FOR_REVIEW")


def derive_packets(runs: DataFrame, issues: DataFrame, gates: DataFrame, missing: DataFrame, conflicts: DataFrame, confidence: DataFrame) -> DataFrame:
    """run, status, packet (canonical JSON), packet_hash of runs (run).

    ``issues``: run, issue, status (RESOLVED, CONDITIONAL or else). ``gates``: run, gate,
    passed. ``missing`` and ``conflicts``: run, item. ``confidence``: run, score. A failed
    gate, or no resolved issue, abstains; then missing inputs and conflicts ask for
    input; then unresolved issues make it partial.
    """
    good = F.col("status").isin("RESOLVED", "CONDITIONAL")
    per_issue = issues.groupBy("run").agg(F.count(F.lit(1)).alias("n_issues"), F.count_if(good).alias("n_resolved"), F.array_sort(F.collect_set(F.when(~good, F.col("issue").cast("string")))).alias("unresolved"))
    failed = gates.where(~F.coalesce("passed", F.lit(False))).groupBy("run").agg(F.array_sort(F.collect_set("gate")).alias("failed_gates"))
    listed = lambda df, name: df.groupBy("run").agg(F.array_sort(F.collect_set("item")).alias(name))
    parts = [per_issue, failed, listed(missing, "missing_inputs"), listed(conflicts, "conflicts"), confidence.select("run", "score")]
    joined = reduce(lambda a, b: a.join(b, "run", "left"), parts, runs.select("run").distinct())
    none = F.array().cast("array<string>")
    full = joined.withColumns({c: F.coalesce(c, none) for c in ("failed_gates", "missing_inputs", "conflicts", "unresolved")} | {c: F.coalesce(c, F.lit(0)) for c in ("n_issues", "n_resolved")})
    status = (
        F.when((F.size("failed_gates") > 0) | (F.col("n_resolved") == 0), STATUS[0]).when((F.size("missing_inputs") > 0) | (F.size("conflicts") > 0), STATUS[1])
        .when(F.col("n_resolved") < F.col("n_issues"), STATUS[2]).otherwise(STATUS[3])
    )
    made = full.withColumn("status", status)
    fields = ("run", "status", "score", "n_issues", "n_resolved", "failed_gates", "missing_inputs", "conflicts", "unresolved")
    packet = canonical_json(**{f: F.col(f) for f in fields})
    return made.select("run", "status", packet.alias("packet")).withColumn("packet_hash", F.sha2("packet", 256))


def verify_packets(derived: DataFrame, stored: DataFrame) -> DataFrame:
    """run, code of stored packets (run, packet, packet_hash) that aren't what their run gives."""
    s = stored.select("run", F.col("packet").alias("p"), F.col("packet_hash").alias("h"))
    joined = derived.join(s, "run", "full")
    code = F.when(F.col("h").isNull(), "PACKET_MISSING").when(F.col("packet").isNull(), "UNKNOWN_RUN").when(F.sha2("p", 256) != F.col("h"), "PACKET_HASH_MISMATCH").when(F.col("p") != F.col("packet"), "PACKET_DIFFERS")
    return joined.select("run", code.alias("code")).where("code IS NOT NULL")


def verify_artifacts(required: DataFrame, said: DataFrame, stored: DataFrame) -> DataFrame:
    """run, path, code of artifacts: required (run, path) ones that aren't there, and differences between the manifest and the files (run, path, sha256)."""
    keys = ["run", "path"]
    m, f = said.select(*keys, F.col("sha256").alias("m")), stored.select(*keys, F.col("sha256").alias("f"))
    both = m.join(f, keys, "full").join(required.select(*keys, F.lit(True).alias("needed")).distinct(), keys, "full")
    code = (
        F.when(F.col("needed") & F.col("f").isNull(), "REQUIRED_MISSING").when(F.col("f").isNull(), "MISSING").when(F.col("m").isNull(), "UNDECLARED")
        .when(F.col("m") != F.col("f"), "HASH_MISMATCH")
    )
    return both.select(*keys, code.alias("code")).where("code IS NOT NULL")


def release_errors(derived: DataFrame, stored: DataFrame, decisions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """run, code: why a run may not be released.

    Its packet must agree and be ready, its artifacts have no finding (``artifacts`` as
    of ``verify_artifacts``), and its latest decision (run, at, packet_hash, decision)
    approve this very packet.
    """
    latest = decisions.groupBy("run").agg(F.max(F.struct("at", "packet_hash", "decision")).alias("d"))
    decided = derived.join(latest, "run", "left")
    code = F.when(F.col("status") != STATUS[3], "NOT_READY").when(F.col("d").isNull(), "NOT_DECIDED").when(F.col("d.packet_hash") != F.col("packet_hash"), "DECISION_OF_OTHER_PACKET").when(F.col("d.decision") != "APPROVED", "NOT_APPROVED")
    found = [decided.select("run", code.alias("code")).where("code IS NOT NULL"), verify_packets(derived, stored), artifacts.select("run", F.concat(F.lit("ARTIFACT_"), "code").alias("code"))]
    return reduce(DataFrame.unionByName, found).distinct()


def byte_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """path, same: artifacts (path, sha256) of two runs; false where one lacks it or they differ."""
    joined = left.select("path", F.col("sha256").alias("l")).join(right.select("path", F.col("sha256").alias("r")), "path", "full")
    return joined.select("path", F.coalesce(F.col("l") == F.col("r"), F.lit(False)).alias("same"))


def compare_parser_runs(runs: DataFrame, differences: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pair, status of pairs of parser runs (pair, left_environment, right_environment).

    ENVIRONMENT_MISMATCH if they didn't run alike, BYTE_IDENTICAL if all artifacts
    (pair, path, sha256) agree, EQUIVALENT if these differ and the typed differences
    (pair, kind) are none, else DIFFERENT.
    """
    l, r = (side.select("pair", "path", F.col("sha256").alias(n)) for side, n in ((left, "l"), (right, "r")))
    same = l.join(r, ["pair", "path"], "full").groupBy("pair").agg(F.bool_and(F.coalesce(F.col("l") == F.col("r"), F.lit(False))).alias("same"))
    counted = differences.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    joined = runs.join(same, "pair", "left").join(counted, "pair", "left")
    status = F.when(~F.col("left_environment").eqNullSafe(F.col("right_environment")), "ENVIRONMENT_MISMATCH").when(F.coalesce("same", F.lit(True)), "BYTE_IDENTICAL").when(F.coalesce("n", F.lit(0)) == 0, "EQUIVALENT").otherwise("DIFFERENT")
    return joined.select("pair", status.alias("status"))


def review_views(derived: DataFrame, claims: DataFrame, citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """One document per run for reviewers: the packet and its claims (run, claim, text), each with its citations (run, claim, evidence) resolved to evidence (evidence, document, page, text).

    A run's claims are a page for a human; they fit a row.
    """
    held = citations.join(evidence, "evidence", "left").withColumn("resolved", F.col("document").isNotNull())
    cited = held.groupBy("run", "claim").agg(F.array_sort(F.collect_list(F.struct("evidence", "resolved", "document", "page", F.col("text").alias("quote")))).alias("citations"))
    empty = F.array().cast(cited.schema["citations"].dataType)
    listed = claims.join(cited, ["run", "claim"], "left").groupBy("run").agg(F.array_sort(F.collect_list(F.struct("claim", "text", F.coalesce("citations", empty).alias("citations")))).alias("claims"))
    return derived.select("run", "status", "packet_hash").join(listed, "run", "left")
