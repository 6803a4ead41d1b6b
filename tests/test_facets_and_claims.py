"""Facets of issues, facts against thresholds, and claims on small tables."""

import pytest
from pyspark.sql import functions as F

from veridock.operators import claims, facets


def required(spark, question, whole=""):
    issues = spark.createDataFrame([("p", "i", question)], "plan string, issue string, question string")
    return facets.required_facets(issues, spark.createDataFrame([("p", whole)], "plan string, question string")).first()["facets"]


def test_what_a_question_needs(spark):
    assert required(spark, "최소 면적 기준은?") == ["minimum-area-threshold"]
    assert required(spark, "역세권 승강장 완화 조건") == ["distance-normal-threshold", "distance-conditional-threshold"]
    assert required(spark, "임대형기숙사 복합 주차") == ["dormitory-parking-standard", "mixed-use-parking-application"]
    assert required(spark, "산업부지 확보비율 심의") == ["industrial-site-ratio", "industrial-site-relaxation-procedure"]
    assert required(spark, "준공업지역 용적률, 지구단위계획 주차") == ["semi-industrial-far-threshold", "district-plan-parking-relaxation"]
    assert required(spark, "부지 1,500㎡ 사업 가능?") == ["minimum-area-threshold"]
    assert required(spark, "아무 질문") == []


def test_an_area_in_the_same_sentence_counts(spark):
    issue = "부지에서 300m 떨어진 사업이 가능한가?"
    assert required(spark, issue, "승강장에서 300m인 부지는 1,500㎡이다. 다른 글.") == ["minimum-area-threshold"]
    assert required(spark, issue, "승강장에서 300m이다. 부지는 1,500㎡이다.") == []
    assert required(spark, issue, "승강장에서 200m인 부지는 1,500㎡이다.") == []


def test_requests_for_what_no_request_covers(spark):
    need = spark.createDataFrame([("p", "i", ["minimum-area-threshold", "distance-normal-threshold", "distance-conditional-threshold"]), ("p", "j", ["industrial-site-ratio"])], "plan string, issue string, facets array<string>")
    asked = spark.createDataFrame([("p", "i", "q1", "rule", "대지 면적"), ("p", "j", "q2", "fact", "산업부지 확보비율")], "plan string, issue string, request string, role string, text string")
    got = {tuple(r) for r in facets.facet_requests(need, asked).collect()}
    assert got == {("p", "i", "FACET-i-distance-normal-threshold", "역세권 승강장 경계 거리 기준"), ("p", "j", "FACET-j-industrial-site-ratio", "준공업지역 산업부지 확보비율")}
    many = spark.createDataFrame([("p", "x", f"q{k}", "fact", "t") for k in range(24)], asked.schema)
    with pytest.raises(ValueError, match="27 requests"):
        facets.facet_requests(need, asked.limit(0).union(many))


def test_what_evidence_states(spark):
    texts = [
        (1, "대지면적 1,000㎡ 이상"), (2, "면적"), (3, "승강장 경계 250m 이내. 다만 350m 까지"), (4, "임대형기숙사를 제외한 주차"), (5, "임대형기숙사 주차"), (6, "준공업 용적률 399%"), (7, "준공업 용적률 400%"),
        (8, "산업부지 확보비율은 10분의 1"), (9, "산업부지 확보비율과 기부비율 20%"), (10, "산업부지 확보비율 위원회 20 %"), (11, "복합 각각 적용"), (12, None), (13, "산업부지 확보비율 " + "가" * 20_000 + " 5%"),
    ]
    got = {r["evidence"]: r["facets"] for r in facets.matched_facets(spark.createDataFrame(texts, "evidence int, text string")).collect()}
    assert got[1] == ["minimum-area-threshold"] and got[2] == [] and got[3] == ["distance-normal-threshold", "distance-conditional-threshold"]
    assert got[4] == ["private-rental-parking-standard"] and got[5] == ["dormitory-parking-standard"] and got[6] == [] and got[7] == ["semi-industrial-far-threshold"]
    assert got[8] == ["industrial-site-ratio"] and got[9] == [] and got[10] == ["industrial-site-ratio", "industrial-site-relaxation-procedure"]
    assert got[11] == ["mixed-use-parking-application"] and not got[12] and got[13] == ["industrial-site-ratio"]


def test_facts_against_thresholds(spark):
    covered = spark.createDataFrame([("p", "i", "minimum-area-threshold", ["e1", "e2"]), ("p", "i", "distance-normal-threshold", ["e3"]), ("p", "j", "minimum-area-threshold", ["e1"]), ("p", "k", "minimum-area-threshold", [])], "plan string, issue string, facet string, evidence array<string>")
    facts = spark.createDataFrame([("p", "i", "부지 1,200.50㎡"), ("p", "i", "거리 300m"), ("p", "j", "10㎡"), ("p", "j", "20㎡"), ("p", "k", "5㎡")], "plan string, issue string, text string")
    texts = spark.createDataFrame([("e1", "면적 1,000㎡"), ("e2", "면적 1,500㎡ 또는 900㎡"), ("e3", "승강장 250m, 다만 350m")], "evidence string, text string")
    got = {(r["issue"], r["facet"]): (r["operator"], r["fact"], r["threshold"], r["satisfied"]) for r in facets.comparisons(covered, facts, texts).collect()}
    assert got == {("i", "minimum-area-threshold"): (">=", "1200.5", "900", True), ("i", "distance-normal-threshold"): ("<=", "300", "250", False)}


CLAIM = "run string, claim string, text string, issues array<string>, citations array<string>, facets array<string>, tokens array<string>, calculations array<string>, rules array<struct<result:string,hash:string,status:string>>"


def claim(name, text="t", issues=("i1",), citations=("c1",), facets=(), tokens=(), calculations=(), rules=()):
    return ("r", name, text, list(issues), list(citations), list(facets), list(tokens), list(calculations), list(rules))


def codes(df):
    return {(r["claim"], r["code"], r["detail"]) for r in df.collect()}


def test_structure_of_claims(spark):
    rows = [claim("ok", facets=("f1",)), claim("twice"), claim("twice"), claim("empty", text=" "), claim("bare", citations=()), claim("wild", citations=("c1", "zz")), claim("off", issues=("i9",)), claim("other", citations=("c2",)), claim("any", citations=("c3",)), claim("facet", facets=("f9",))]
    evidence = spark.createDataFrame([("r", "c1", ["i1"], "x"), ("r", "c2", ["i2"], "x"), ("r", "c3", [], "x")], "run string, citation string, issues array<string>, text string")
    issues = spark.createDataFrame([("r", "i1"), ("r", "i2")], "run string, issue string")
    need = spark.createDataFrame([("r", "i1", "f1")], "run string, issue string, facet string")
    declared = spark.createDataFrame([("r", c) for c in ("c1", "c1", "c2", "c7", "zz")], "run string, citation string")
    got = codes(claims.structure_errors(spark.createDataFrame(rows, CLAIM), evidence, issues, need, declared))
    assert got == {
        ("twice", "DUPLICATE_CLAIM", "2"), ("empty", "EMPTY_TEXT", None), ("bare", "UNCITED", None), ("wild", "UNKNOWN_CITATION", "zz"), ("off", "UNPLANNED_ISSUE", "i9"), ("off", "CITATION_OF_OTHER_ISSUE", "c1"), ("other", "CITATION_OF_OTHER_ISSUE", "c2"),
        ("facet", "FACET_NOT_REQUIRED", "f9"), (None, "DECLARED_TWICE", "c1"), (None, "DECLARED_UNUSED", "c7"), (None, "USED_UNDECLARED", "c3"),
    }


def test_numbers_of_claims_are_accounted_for(spark):
    rows = [
        claim("cited", "12 and 1,000"), claim("input", "about 77%"), claim("calc", "9.5", calculations=("k1",)), claim("failed", "9.5", calculations=("k2",)), claim("compared", "300 over 250", citations=("c1", "c2")), claim("part", "300 over 250"),
        claim("tokens", "12 and 77%", tokens=("12",)), claim("odd", "12 and 1e5"), claim("none", None), claim("free", "41"),
    ]
    evidence = spark.createDataFrame([("r", "c1", ["i1"], "12 of 1,000"), ("r", "c2", ["i1"], None)], "run string, citation string, issues array<string>, text string")
    inputs = spark.createDataFrame([("r", "77%")], "run string, text string")
    calculations = spark.createDataFrame([("r", "k1", "SUCCESS", "9.5"), ("r", "k2", "ERROR", "9.5")], "run string, calculation string, status string, text string")
    compared = spark.createDataFrame([("r", "i1", ["c1", "c2"], "300", "250")], "run string, issue string, evidence array<string>, fact string, threshold string")
    got = codes(claims.number_errors(spark.createDataFrame(rows, CLAIM), evidence, inputs, calculations, compared))
    assert got == {
        ("failed", "UNREGISTERED_NUMBER", "9.5"), ("failed", "INVALID_CALCULATION", "k2"), ("part", "UNREGISTERED_NUMBER", "300"), ("part", "UNREGISTERED_NUMBER", "250"), ("tokens", "NUMERIC_TOKEN_MISMATCH", "12"),
        ("odd", "UNSUPPORTED_NUMERIC_SYNTAX", "7:10: 1e5"), ("free", "UNREGISTERED_NUMBER", "41"),
    }


def test_rule_results_are_those_of_the_run(spark):
    rows = [claim("ok", rules=[("a", "h", "PASS")]), claim("hash", rules=[("a", "x", "PASS")]), claim("status", rules=[("a", "h", "FAIL")]), claim("gone", rules=[("b", "h", "PASS")]), claim("no", rules=[])]
    results = spark.createDataFrame([("r", "a", "h", "PASS"), ("q", "b", "h", "PASS")], "run string, result string, hash string, status string")
    got = claims.rule_errors(spark.createDataFrame(rows, CLAIM), results)
    assert codes(got) == {("hash", "RULE_RESULT_MISMATCH", "a"), ("status", "RULE_RESULT_MISMATCH", "a"), ("gone", "RULE_RESULT_MISMATCH", "b")}
    assert got.where(F.col("run") != "r").count() == 0
