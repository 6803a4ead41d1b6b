"""Facets of an issue: what a question needs, which requests and evidence serve it, and its facts compared with the thresholds of rules.

A facet is a row of a table: groups of words, of each of which one must stand in the
text, and a measure. All tests are column expressions made from that table. Joins are
by shuffle: every table grows with the issues, and the size of a file says little of
the arrays that are derived from it, so Spark would broadcast them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridock.functions.canonical import canonical_json, content_id
from veridock.functions.numbers import decimal_text, measures
from veridock.functions.text import match_text

Words = tuple[tuple[str, ...], ...]


@dataclass(frozen=True)
class Facet:
    """``asked``, ``covered``, ``met``: words that a question, a request, a piece of evidence must have. ``measure``: what evidence must state, as dimension, conditional or not (None: either), least value. ``compare``: the operator between a fact and the threshold."""

    name: str
    asked: Words
    search: str
    covered: Words
    met: Words
    measure: tuple[str, bool | None, int] | None = None
    compare: str | None = None


#: Fixed values.
FACETS = (
    Facet("minimum-area-threshold", (("최소",), ("면적",)), "사업대상지 최소 면적", (("면적",), ("최소", "대지")), (("면적",),), ("area_m2", None, 0), ">="),
    Facet("distance-normal-threshold", (("승강장",), ("역세권", "거리")), "역세권 승강장 경계 거리 기준", (("승강장",), ("거리", "역세권")), (("승강장",),), ("length_m", False, 0), "<="),
    Facet("distance-conditional-threshold", (("승강장",), ("역세권", "거리"), ("조건", "완화", "검토 대상")), "역세권 승강장 경계 거리 기준", (("승강장",), ("거리", "역세권")), (("승강장",),), ("length_m", True, 0), "<="),
    Facet("private-rental-parking-standard", (("공공지원민간임대주택",), ("주차",)), "공공지원민간임대주택 주차장 설치기준", (("공공지원민간임대주택",), ("주차",)), (("주차",), ("공공지원민간임대주택", "임대형기숙사를 제외"))),
    Facet("dormitory-parking-standard", (("임대형기숙사",), ("주차",)), "임대형기숙사 주차장 설치기준", (("임대형기숙사",), ("주차",)), (("임대형기숙사",), ("주차",))),
    Facet("mixed-use-parking-application", (("임대형기숙사",), ("주차",), ("복합",)), "복합 주차장 설치기준 각각 적용", (("복합",), ("주차",)), (("복합",), ("적용",), ("각각", "각 주택"))),
    Facet("semi-industrial-far-threshold", (("준공업",), ("용적률",)), "준공업지역 공동주택 기본용적률", (("준공업",), ("용적률",)), (("준공업",), ("용적률",)), ("percent", None, 400), "<="),
    Facet("industrial-site-ratio", (("산업부지",), ("확보비율",)), "준공업지역 산업부지 확보비율", (("산업부지",), ("확보비율",)), (("산업부지",), ("확보비율",))),
    Facet("industrial-site-relaxation-procedure", (("산업부지",), ("확보비율",), ("완화", "절차", "심의")), "산업부지 확보비율 심의 완화 절차", (("산업부지",), ("확보비율",), ("심의", "완화", "절차")), (("산업부지",), ("확보비율",), ("심의", "위원회", "절차"))),
    Facet("district-plan-parking-relaxation", (("지구단위계획",), ("주차",)), "지구단위계획 주차장 설치기준 완화", (("지구단위계획",), ("주차",)), (("지구단위계획",), ("주차",), ("완화",))),
)
#: An exclusion that turns a facet's words round, a ratio, and the labels one of which names it.
EXCLUDED = r"임대형기숙사(?:를)?\s*제외"
RATIO = r"(?:[0-9]+\s*분의\s*[0-9]+|[0-9]+(?:\.[0-9]+)?\s*(?:%|퍼센트))"
RATIO_MARKER, RATIO_LABEL = "산업부지 확보비율", "[0-9a-z가-힣]+비율"
SENTENCE = r"(?<=[.!?。！？])\s+|\n+"
MAX_REQUESTS = 24


def has_words(text: Column, words: Words) -> Column:
    """One of each group stands in a text in normal form."""
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [text.contains(w) for w in group]) for group in words])


def has_measure(found: Column, dimension: str, conditional: bool | None = None, least: int = 0) -> Column:
    """An array of measures has one of the dimension."""
    fits = lambda m: (m["dimension"] == dimension) & (F.lit(True) if conditional is None else m["conditional"] == conditional) & (m["value"] >= least)
    return F.exists(found, fits)


def has_site_ratio(text: Column) -> Column:
    """A ratio stands behind the marker with no other label between."""
    behind = F.slice(F.split(text, RATIO_MARKER), 2, F.greatest(F.size(F.split(text, RATIO_MARKER)) - 1, F.lit(1)))
    return F.exists(behind, lambda p: F.split(p, RATIO_LABEL, 2)[0].rlike(RATIO))


def _when(pairs: list[tuple[Column, str]]) -> Column:
    """Names whose test holds, in order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in pairs]))


def required_facets(issues: DataFrame, plans: DataFrame) -> DataFrame:
    """plan, issue, facets (in order) of issues (plan, issue, question) and plans (plan, question).

    A site's area may stand in the question of the plan only: it counts for an issue
    that names a site and a distance, if a sentence there has both that distance and
    an area.
    """
    rows = issues.select("plan", "issue", "question", match_text(F.col("question")).alias("t"), measures("question").alias("m"))
    sentences = plans.select("plan", F.explode(F.split("question", SENTENCE)).alias("s"))
    sentences = sentences.select("plan", F.trim("s").alias("s"), measures("s").alias("sm"))
    goal = lambda text: text.contains("부지") & has_words(text, (("사업", "추진", "가능", "충족"),))
    area = sentences.where(has_measure(F.col("sm"), "area_m2")).select("plan", match_text(F.col("s")).alias("st"), F.explode("sm").alias("x"))
    near = area.where("x.dimension = 'length_m'").select("plan", F.col("x.value").alias("v"), "st")
    distances = rows.select("plan", "issue", "t", F.explode("m").alias("x")).where("x.dimension = 'length_m'").select("plan", "issue", "t", F.col("x.value").alias("v"))
    met = distances.join(near.hint("merge"), ["plan", "v"]).where(F.col("t").contains("부지") & goal(F.concat_ws(" ", "t", "st"))).select("plan", "issue", F.lit(True).alias("by_context")).distinct()
    joined = rows.join(met.hint("merge"), ["plan", "issue"], "left")
    own = has_measure(F.col("m"), "area_m2") & goal(F.col("t"))
    tests = [(has_words(F.col("t"), f.asked) | (own | F.coalesce("by_context", F.lit(False)) if f.name == "minimum-area-threshold" else F.lit(False)), f.name) for f in FACETS]
    return joined.select("plan", "issue", _when(tests).alias("facets"))


def facet_requests(required: DataFrame, requests: DataFrame) -> DataFrame:
    """plan, issue, request, text: one request of role rule for each facet that no such request of its issue covers.

    ``requests`` (plan, issue, request, role, text). Facets that search by the same
    text share one request. A plan with more than 24 requests in all is an error.
    """
    asked = requests.where("role = 'rule'").select("plan", "issue", match_text(F.col("text")).alias("t"))
    served = asked.select("plan", "issue", F.explode(_when([(has_words(F.col("t"), f.covered), f.name) for f in FACETS])).alias("facet")).distinct()
    texts = F.create_map(*[F.lit(x) for f in FACETS for x in (f.name, f.search)])
    open_facets = required.select("plan", "issue", F.posexplode("facets").alias("ord", "facet")).join(served.hint("merge"), ["plan", "issue", "facet"], "left_anti").withColumn("text", texts[F.col("facet")])
    made = open_facets.groupBy("plan", "issue", "text").agg(F.min_by("facet", "ord").alias("facet")).select("plan", "issue", F.concat_ws("-", F.lit("FACET"), "issue", "facet").alias("request"), "text")
    per_plan = requests.select("plan", "request").distinct().union(made.select("plan", "request")).groupBy("plan").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_REQUESTS).first()
    if per_plan:
        raise ValueError(f"plan {per_plan['plan']} would have {per_plan['n']} requests, more than {MAX_REQUESTS}")
    return made


def matched_facets(evidence: DataFrame) -> DataFrame:
    """evidence, facets: what each text (evidence, text) states. The facets of one text are independent of each other."""
    rows = evidence.select("evidence", match_text(F.col("text")).alias("t"), measures("text").alias("m"))

    def test(f: Facet) -> Column:
        out = has_words(F.col("t"), f.met)
        if f.measure:
            out = out & has_measure(F.col("m"), *f.measure)
        if f.name == "dormitory-parking-standard":
            out = out & ~F.col("t").rlike(EXCLUDED)
        return out & has_site_ratio(F.col("t")) if f.name == "industrial-site-ratio" else out

    return rows.select("evidence", _when([(test(f), f.name) for f in FACETS]).alias("facets"))


def coverage(required: DataFrame, found: DataFrame, selected: DataFrame) -> DataFrame:
    """plan, issue, facet, evidence: required facets with the evidence that serves them, an empty array where it is missing.

    ``found`` as of ``matched_facets``, ``selected`` (plan, issue, evidence).
    """
    served = selected.join(found.select("evidence", F.explode("facets").alias("facet")).hint("merge"), "evidence").groupBy("plan", "issue", "facet").agg(F.sort_array(F.collect_set("evidence")).alias("evidence"))
    wanted = required.select("plan", "issue", F.explode("facets").alias("facet"))
    return wanted.join(served.hint("merge"), ["plan", "issue", "facet"], "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))


def compare_fact(facet: Column, fact: Column, rule: Column) -> Column:
    """Struct operator, fact, threshold, unit, satisfied from measures of a fact and of a rule; null if the facet has no comparison, the fact not exactly one such measure, or the rule none."""
    out = F.lit(None).cast("struct<operator:string,fact:string,threshold:string,unit:string,satisfied:boolean>")
    for f in FACETS:
        if f.compare:
            dimension, conditional, _ = f.measure
            mine = F.transform(F.filter(fact, lambda m: m["dimension"] == dimension), lambda m: m["value"])
            theirs = F.transform(F.filter(rule, lambda m: (m["dimension"] == dimension) & (F.lit(True) if conditional is None else m["conditional"] == conditional)), lambda m: m["value"])
            limit = F.array_min(theirs) if f.compare == ">=" else F.array_max(theirs)
            holds = mine[0] >= limit if f.compare == ">=" else mine[0] <= limit
            made = F.struct(F.lit(f.compare).alias("operator"), decimal_text(F.get(mine, 0)).alias("fact"), decimal_text(limit).alias("threshold"), F.lit(dimension).alias("unit"), holds.alias("satisfied"))
            out = F.when((facet == f.name) & (F.size(mine) == 1) & (F.size(theirs) > 0), made).otherwise(out)
    return out


def comparisons(covered: DataFrame, facts: DataFrame, texts: DataFrame) -> DataFrame:
    """plan, issue, facet, id, operator, fact, threshold, unit, satisfied, evidence.

    ``covered`` as of ``coverage``, ``facts`` (plan, issue, text) the facts bound to an
    issue, ``texts`` (evidence, text). A facet with one fact of its unit alone is
    compared with the threshold of its evidence.
    """
    units = F.create_map(*[F.lit(x) for f in FACETS if f.compare for x in (f.name, f.measure[0])])
    wanted = covered.withColumn("unit_", units[F.col("facet")]).where("unit_ IS NOT NULL AND size(evidence) > 0")
    bound = facts.select("plan", "issue", "text", measures("text").alias("fm")).select("plan", "issue", "fm", F.explode(F.array_distinct(F.transform("fm", lambda m: m["dimension"]))).alias("unit_"))
    only = bound.groupBy("plan", "issue", "unit_").agg(F.count(F.lit(1)).alias("n"), F.any_value("fm").alias("fm")).where("n = 1").drop("n")
    flat = wanted.select("plan", "issue", "facet", F.explode("evidence").alias("e")).join(texts.select(F.col("evidence").alias("e"), measures("text").alias("rm")).hint("merge"), "e")
    ruled = flat.groupBy("plan", "issue", "facet").agg(F.flatten(F.collect_list("rm")).alias("rm"))
    joined = wanted.join(only.hint("merge"), ["plan", "issue", "unit_"]).join(ruled.hint("merge"), ["plan", "issue", "facet"]).withColumn("c", compare_fact(F.col("facet"), F.col("fm"), F.col("rm"))).where("c IS NOT NULL")
    text = lambda c: F.col(c).cast("string")
    payload = canonical_json(issue_id=text("issue"), facet_id=F.col("facet"), operator=F.col("c.operator"), fact_value=F.col("c.fact"), threshold_value=F.col("c.threshold"), unit=F.col("c.unit"), satisfied=F.col("c.satisfied"), evidence_ids=F.col("evidence"))
    return joined.select("plan", "issue", "facet", content_id("CMP-", payload).alias("id"), "c.operator", "c.fact", "c.threshold", "c.unit", "c.satisfied", "evidence")
