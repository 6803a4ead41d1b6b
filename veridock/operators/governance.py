"""Governed rules: golden cases run on the cluster, approvals verified by their chain of hashes, and the manifest of what is active.

A rule is active if an approval names a candidate, an approved text and a golden
report, all of which exist with the hashes it names, and the report is of that text
and has no failure. Every step is a join of tables by id, version or hash, shuffled:
hashes are larger than the columns that Spark judges a table by before it broadcasts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridock.functions.canonical import canonical_json
from veridock.operators.rules import TYPES, Rule, evaluate, select_rules

RESULTS = "rule_id string, version string, case string, expected string, actual string, passed boolean"


def golden_results(rules: list[Rule], cases: DataFrame) -> DataFrame:
    """rule_id, version, case, expected, actual, passed of cases (rule_id, version, case, inputs: map of text, expected status).

    A case of no known rule has a null actual and fails. Each rule's condition is one
    expression over its own cases.
    """
    done = []
    for rule in rules:
        own = cases.where((F.col("rule_id") == rule.rule_id) & (F.col("version") == rule.version))
        inputs = {n: F.col("inputs")[n].try_cast(TYPES[t]) for n, (t, _) in rule.inputs.items()}
        made = evaluate(rule, inputs, {n: F.map_contains_key("inputs", n) for n in inputs})
        done.append(own.select("rule_id", "version", "case", "expected", made["status"].alias("actual")))
    known = cases.sparkSession.createDataFrame([(r.rule_id, r.version) for r in rules], "rule_id string, version string")
    done.append(cases.join(F.broadcast(known), ["rule_id", "version"], "left_anti").select("rule_id", "version", "case", "expected", F.lit(None).cast("string").alias("actual")))
    return reduce(DataFrame.unionByName, done).withColumn("passed", F.coalesce(F.col("actual") == F.col("expected"), F.lit(False)))


def golden_reports(results: DataFrame, texts: DataFrame) -> DataFrame:
    """rule_id, version, text_hash, n_cases, n_passed, report_hash: one row per tested text of texts (rule_id, version, text).

    The hash covers the text's hash and every case with its outcome, in order of case.
    """
    case = F.struct("case", "expected", "actual", "passed")
    counted = results.groupBy("rule_id", "version").agg(F.count(F.lit(1)).alias("n_cases"), F.count_if("passed").alias("n_passed"), F.array_sort(F.collect_list(case)).alias("cases"))
    joined = counted.join(texts.select("rule_id", "version", F.sha2("text", 256).alias("text_hash")).hint("merge"), ["rule_id", "version"])
    payload = canonical_json(rule_id=F.col("rule_id"), version=F.col("version"), text_hash=F.col("text_hash"), cases=F.col("cases"))
    return joined.select("rule_id", "version", "text_hash", "n_cases", "n_passed", F.sha2(payload, 256).alias("report_hash"))


def verify_approvals(approvals: DataFrame, candidates: DataFrame, approved: DataFrame, reports: DataFrame) -> DataFrame:
    """Approvals with ``codes``: what breaks their chain, empty if it holds.

    ``approvals``: approval, rule_id, version, candidate_hash, approved_hash,
    report_hash, reviewer, reviewed_at. ``candidates`` and ``approved``: rule_id,
    version, text. ``reports`` as of ``golden_reports``.
    """
    def hashed(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("rule_id", "version").agg(F.max(F.sha2("text", 256)).alias(name))

    keys = ["rule_id", "version"]
    tested = reports.groupBy(*keys).agg(F.max_by(F.struct("report_hash", "text_hash", "n_cases", "n_passed"), "report_hash").alias("golden"))
    joined = approvals.join(hashed(candidates, "c").hint("merge"), keys, "left").join(hashed(approved, "a").hint("merge"), keys, "left").join(tested.hint("merge"), keys, "left")
    gone = lambda c: F.col(c).isNull()
    checks = [
        (F.coalesce(F.trim("reviewer"), F.lit("")) == "", "REVIEWER_MISSING"), (gone("reviewed_at"), "REVIEW_DATE_MISSING"),
        (gone("c"), "CANDIDATE_MISSING"), (F.col("c") != F.col("candidate_hash"), "CANDIDATE_HASH_MISMATCH"),
        (gone("a"), "APPROVED_MISSING"), (F.col("a") != F.col("approved_hash"), "APPROVED_HASH_MISMATCH"), (F.col("a") != F.col("c"), "APPROVED_DIFFERS_FROM_CANDIDATE"),
        (gone("golden"), "GOLDEN_MISSING"), (F.col("golden.report_hash") != F.col("report_hash"), "GOLDEN_HASH_MISMATCH"), (F.col("golden.text_hash") != F.col("a"), "GOLDEN_OF_OTHER_TEXT"),
        (F.col("golden.n_passed") < F.col("golden.n_cases"), "GOLDEN_FAILED"),
    ]
    codes = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), code) for test, code in checks]))
    return joined.select(*approvals.columns, codes.alias("codes"))


def active_manifest(verified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The manifest (rule_id, version, approved_hash, approval) of rules with one sound approval of one version, and findings (rule_id, code, detail)."""
    sound = verified.where(F.size("codes") == 0)
    broken = verified.where(F.size("codes") > 0).select("rule_id", F.explode("codes").alias("code"), F.col("approval").alias("detail"))
    counts = sound.groupBy("rule_id").agg(F.count_distinct("version").alias("versions"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("version")), ",").alias("list"))
    several = counts.where("versions > 1").select("rule_id", F.lit("SEVERAL_ACTIVE_VERSIONS").alias("code"), F.col("list").alias("detail"))
    # Approvals that repeat one version agree: the first stands for them.
    one = sound.join(counts.where("versions = 1").select("rule_id"), "rule_id", "left_semi")
    manifest = one.groupBy("rule_id", "version", "approved_hash").agg(F.min("approval").alias("approval"))
    return manifest, broken.unionByName(several)


def promote(approved: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates (rule_id, version, text) added to the approved ones; and conflicts: versions that are there with another text, which stay as they are."""
    keys = ["rule_id", "version"]
    there = approved.select(*keys, F.col("text").alias("old"))
    fresh = candidates.join(there, keys, "left_anti").dropDuplicates(keys)
    conflicts = candidates.join(there, keys).where(~F.col("old").eqNullSafe(F.col("text"))).select(*keys)
    return approved.select(*keys, "text").unionByName(fresh.select(*keys, "text")), conflicts.distinct()


def load_governed(manifest: DataFrame, texts: DataFrame, rules: DataFrame, contexts: DataFrame, scopes: list[str]) -> DataFrame:
    """context, rule_id, code: null for active rules that fit a context, else why not.

    ``rules`` (rule_id and scopes), ``texts`` (rule_id, version, text). A rule without a
    manifest row is NOT_ACTIVE, one whose text isn't the approved one HASH_MISMATCH.
    """
    stored = manifest.join(texts.select("rule_id", "version", F.sha2("text", 256).alias("h")), ["rule_id", "version"], "left")
    state = stored.select("rule_id", F.when(~F.coalesce(F.col("h") == F.col("approved_hash"), F.lit(False)), "HASH_MISMATCH").otherwise("").alias("state"))
    fits = select_rules(rules, contexts, scopes).join(state, "rule_id", "left")
    code = F.when(F.col("state").isNull(), "NOT_ACTIVE").when(F.col("state") != "", F.col("state")).otherwise(F.col("code"))
    return fits.select("context", "rule_id", code.alias("code"))
