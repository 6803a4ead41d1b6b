"""Claims of a drafted answer against what the run knows: structure, lineage, and every number accounted for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridock.functions.numbers import numeric_texts, unsupported_numeric


def _coded(rows: DataFrame, code: str, detail: Column | str) -> DataFrame:
    return rows.select("run", "claim", F.lit(code).alias("code"), (F.col(detail) if isinstance(detail, str) else detail).cast("string").alias("detail"))


def _flat(claims: DataFrame, column: str, name: str) -> DataFrame:
    return claims.select("run", "claim", F.explode(column).alias(name)).distinct()


def structure_errors(claims: DataFrame, evidence: DataFrame, issues: DataFrame, facets: DataFrame, declared: DataFrame) -> DataFrame:
    """run, claim, code, detail: what is wrong with the shape of claims.

    ``claims``: run, claim, text, issues, citations, facets, tokens (arrays).
    ``evidence``: run, citation, issues, text. ``issues`` (run, issue) are the planned
    ones, ``facets`` (run, issue, facet) the required ones, ``declared`` (run, citation)
    what a draft says it cites. Every test is a join on the run and an id, so the work
    grows with the claims.
    """
    keys = ["run", "citation"]
    cites = _flat(claims, "citations", "citation")
    known = evidence.select("run", "citation", F.col("issues").alias("for_issues"))
    found = cites.join(known, keys)
    named = _flat(claims, "issues", "issue")
    # A citation without issues serves any; else it must serve one of the claim's.
    serves = found.join(claims.select("run", "claim", "issues"), ["run", "claim"]).where((F.size("for_issues") > 0) & (F.size("issues") > 0))
    fulfilled = _flat(claims, "facets", "facet")
    wanted = named.join(facets, ["run", "issue"]).select("run", "claim", "facet").distinct()
    nobody = F.lit(None).cast("string").alias("claim")
    used, said = cites.select(*keys).distinct(), declared.select(*keys)
    return reduce(DataFrame.unionByName, [
        _coded(claims.groupBy("run", "claim").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "DUPLICATE_CLAIM", "n"),
        _coded(claims.where("coalesce(trim(text), '') = ''"), "EMPTY_TEXT", F.lit(None)),
        _coded(claims.where("coalesce(size(citations), 0) <= 0"), "UNCITED", F.lit(None)),
        _coded(cites.join(known, keys, "left_anti"), "UNKNOWN_CITATION", "citation"),
        _coded(named.join(issues, ["run", "issue"], "left_anti"), "UNPLANNED_ISSUE", "issue"),
        _coded(serves.where(~F.arrays_overlap("for_issues", "issues")), "CITATION_OF_OTHER_ISSUE", "citation"),
        _coded(fulfilled.join(wanted, ["run", "claim", "facet"], "left_anti"), "FACET_NOT_REQUIRED", "facet"),
        _coded(said.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("claim", nobody), "DECLARED_TWICE", "citation"),
        _coded(said.join(used, keys, "left_anti").distinct().withColumn("claim", nobody), "DECLARED_UNUSED", "citation"),
        _coded(used.join(said, keys, "left_anti").withColumn("claim", nobody), "USED_UNDECLARED", "citation"),
    ])


def number_errors(claims: DataFrame, evidence: DataFrame, inputs: DataFrame, calculations: DataFrame, comparisons: DataFrame) -> DataFrame:
    """run, claim, code, detail: numbers of claims that nothing accounts for.

    A number of a claim must stand, as written, in a text it cites, in an input of the
    run (run, text), in a calculation it refers to (run, calculation, status, text;
    claims have ``calculations``), or in a comparison (run, issue, evidence, fact,
    threshold) of one of its issues all of whose evidence it cites. The tokens it
    declares must be those of its text, and its text may hold nothing else that looks
    numeric.
    """
    own = numeric_texts(F.coalesce("text", F.lit("")))
    rows = claims.select("run", "claim", "issues", "citations", "tokens", own.alias("numbers"), unsupported_numeric(F.coalesce("text", F.lit(""))).alias("odd"))
    wanted = rows.select("run", "claim", F.explode(F.array_distinct("numbers")).alias("number"))

    def numbers(df: DataFrame, *texts: str) -> Column:
        return F.explode(F.array_distinct(F.flatten(F.array(*[numeric_texts(F.coalesce(t, F.lit(""))) for t in texts])))).alias("number")

    keys = ["run", "claim", "number"]
    # Texts are read once each, however many claims cite them.
    cited = _flat(claims, "citations", "citation").join(evidence.select("run", "citation", numbers(evidence, "text")), ["run", "citation"]).select(*keys)
    given = wanted.join(inputs.select("run", numbers(inputs, "text")).distinct(), ["run", "number"]).select(*keys)
    refers = _flat(claims, "calculations", "calculation")
    good = calculations.where("status = 'SUCCESS'")
    made = refers.join(good.select("run", "calculation", numbers(good, "text")), ["run", "calculation"]).select(*keys)
    compared = comparisons.select("run", "issue", F.col("evidence").alias("needs"), F.array_distinct(F.flatten(F.array(numeric_texts("fact"), numeric_texts("threshold")))).alias("ns"))
    about = rows.select("run", "claim", "citations", F.explode("issues").alias("issue")).join(compared, ["run", "issue"]).where(F.size(F.array_except("needs", "citations")) == 0)
    known = reduce(DataFrame.union, [cited, given, made, about.select("run", "claim", F.explode("ns").alias("number"))]).distinct()
    return reduce(DataFrame.unionByName, [
        _coded(wanted.join(known, keys, "left_anti"), "UNREGISTERED_NUMBER", "number"),
        _coded(rows.where((F.size("tokens") > 0) & (F.col("tokens") != F.col("numbers"))), "NUMERIC_TOKEN_MISMATCH", F.array_join("tokens", " ")),
        _coded(rows.where("odd IS NOT NULL"), "UNSUPPORTED_NUMERIC_SYNTAX", "odd"),
        _coded(refers.join(good, ["run", "calculation"], "left_anti"), "INVALID_CALCULATION", "calculation"),
    ])


def rule_errors(claims: DataFrame, results: DataFrame) -> DataFrame:
    """run, claim, code, detail: references (``rules``: array of result, hash, status) to rule results (run, result, hash, status) that aren't there or differ."""
    refers = claims.select("run", "claim", F.explode("rules").alias("r")).select("run", "claim", "r.result", F.col("r.hash").alias("h"), F.col("r.status").alias("s"))
    joined = refers.join(results, ["run", "result"], "left")
    differs = F.col("hash").isNull() | ~F.col("hash").eqNullSafe(F.col("h")) | ~F.col("status").eqNullSafe(F.col("s"))
    return _coded(joined.where(differs), "RULE_RESULT_MISMATCH", "result")
