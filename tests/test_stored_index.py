"""The stored index, the cascade and issue-aware retrieval on small tables and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from veridock.operators import cascade, hybrid, inverted_index, issue_retrieval, search
from veridock.operators.budgets import RetrievalPolicy
from veridock.operators.inverted_index import StaleIndexError

DOCS = "key int, text string"


@pytest.fixture
def small(monkeypatch):
    """Many segments and a search that has to open more than the first."""
    monkeypatch.setattr(inverted_index, "SEGMENT_DOCS", 4)
    monkeypatch.setattr(inverted_index, "FIRST_SEGMENTS", 1)


def corpus(spark, n=120, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(30)]
    rows = [(k, " ".join(rng.choices(words, [1 / (j + 1) for j in range(30)], k=rng.randint(0, 25)))) for k in range(n)]
    return rows, spark.createDataFrame([*rows, (n, None), (n + 1, ""), (n + 2, "common " * 50)], DOCS)


def test_top_k_equals_a_full_scan(spark, small, tmp_path):
    _, docs = corpus(spark)
    index = inverted_index.build(inverted_index.documents(docs, "key", "text"), str(tmp_path / "i"))
    assert index.table("blocks").agg(F.max("n")).first()[0] < 40
    asked = {"a": ["w0", "w1"], "b": ["w7", "w7", "w29"], "c": ["none"], "d": ["w0", "none", "w3"], "e": ["common"]}
    queries = spark.createDataFrame(list(asked.items()), "q string, terms array<string>")
    got = inverted_index.top_k(index, queries, 7).collect()
    for q, words in asked.items():
        want = [tuple(r) for r in search.bm25(docs.where("text IS NOT NULL OR true").select("key", F.coalesce("text", F.lit("")).alias("text")), "key", "text", words, 7).collect()]
        mine = [(r["key"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["q"] == q]
        assert [k for k, _ in mine] == [k for k, _ in want]
        assert [s for _, s in mine] == pytest.approx([s for _, s in want])


@pytest.mark.parametrize(("kind", "channel"), [("phrase", "fts_phrase"), ("tokens", "fts_token_and"), ("prefixes", "fts_token_prefix_and")])
def test_channels_equal_a_full_scan(spark, small, tmp_path, kind, channel):
    _, docs = corpus(spark)
    docs = docs.select("key", F.coalesce("text", F.lit("")).alias("text"))
    index = inverted_index.build(docs, str(tmp_path / "i"))
    for words in (["w0", "w1"], ["w2", "w2"], ["w1"], ["w1", "zz"]):
        got = inverted_index.matches(index, spark.createDataFrame([(1, words)], "q int, terms array<string>"), kind, 9).orderBy("rank").collect()
        want = search.channel(docs, "key", "text", words, channel, 9).orderBy("rank").collect()
        assert [(r["key"], r["rank"]) for r in got] == [(r["key"], r["rank"]) for r in want]


def test_terms_are_pushed_into_the_scan(spark, tmp_path):
    _, docs = corpus(spark)
    index = inverted_index.build(inverted_index.documents(docs, "key", "text"), str(tmp_path / "i"))
    plan = index.blocks(spark.createDataFrame([("w3",)], "term string"), "top")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [w3])" in plan or "EqualTo(term,w3)" in plan
    assert "postings" not in plan.split("ReadSchema")[1]


def test_a_stale_index_is_refused(spark, tmp_path):
    _, docs = corpus(spark)
    rows = inverted_index.documents(docs, "key", "text")
    index = inverted_index.build(rows, str(tmp_path / "i"))
    index.require_fresh(rows)
    for other in (rows.where("key <> 5"), rows.withColumn("text", F.when(F.col("key") == 5, "new").otherwise(F.col("text"))), rows.union(rows.limit(1))):
        with pytest.raises(StaleIndexError):
            index.require_fresh(other)
    folder = str(tmp_path / "stored")
    first, again = inverted_index.stored(rows, folder), inverted_index.stored(rows, folder)
    assert first.path == again.path != inverted_index.stored(rows.where("key <> 5"), folder).path


def test_an_empty_index_finds_nothing(spark, tmp_path):
    index = inverted_index.build(spark.createDataFrame([], DOCS), str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, ["a"])], "q int, terms array<string>")
    assert inverted_index.top_k(index, asked, 3).count() == 0
    assert all(inverted_index.matches(index, asked, kind, 3).count() == 0 for kind in inverted_index.KINDS)


def derived(spark, text, facts=None):
    rows = cascade.attempts(spark.createDataFrame([(1, text, facts)], "q int, text string, facts array<string>")).orderBy("ord").collect()
    out = {}
    for r in rows:
        out.setdefault(r["stage"], []).append(r["derived"])
    return out


def test_what_a_query_falls_back_to(spark):
    got = derived(spark, "  공장  용적률 350% 완화 ", ["용적률은 350 % 이다."])
    assert got["PHRASE"] == ["공장 용적률 350% 완화"]
    assert got["FACT_DECONTAMINATED"] == ["공장 용적률 완화"]
    assert got["APPROVED_ALIAS"] == ["공장 기본용적률 350% 완화", "공장 기본용적률 완화"]
    assert got["LEGAL_COMPOUND_DECOMPOSITION"] == ["공장 용적률 350%", "공장 용적률"]
    assert got["CORE_TOKEN_AND"][0] == "용적률 350% 완화" and len(got["CORE_TOKEN_AND"]) == 10
    assert got["HEADING_SCOPED"] == ["공장 용적률 완화"]
    kept = derived(spark, "도로 폭 12m 건축허가 기준", [])
    assert "FACT_DECONTAMINATED" not in kept and "HEADING_SCOPED" not in kept
    assert all("12m" in q and "건축허가" in q for q in kept["CORE_TOKEN_AND"])
    assert derived(spark, "주차장의 설치기준을 검토")["HEADING_SCOPED"] == ["주차장 설치기준"]
    assert derived(spark, " ") == {} and "CORE_TOKEN_AND" not in derived(spark, "one two")


def test_amounts_in_all_spellings(spark):
    row = spark.range(1).select(cascade.amounts(F.array(F.lit("폭 1,200.50 m, 넓이 30㎡ 와 30 m² (5%)"), F.lit("7"))).alias("a")).first()["a"]
    assert {"1200.5:length_m", "30:area_m2", "5:percent", "7:"} <= set(row)


def test_queries_fall_through_to_the_first_stage_with_hits(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red big ring"), (2, "ring that is red"), (3, "redder rings"), (4, "blue big stone"), (5, "green 12m fence law"), (6, "fence law")], DOCS)
    index = inverted_index.build(docs, str(tmp_path / "i"))
    asked = [("p", "red big", None), ("t", "ring red", None), ("x", "redd ring", None), ("s", "blue big hat", None), ("n", "nothing", None), ("e", "Title One", None), ("f", "fence law 99m", ["99 m"]), ("k", "fence 99m law", [])]
    queries = spark.createDataFrame(asked, "q string, text string, facts array<string>")
    labels = spark.createDataFrame([(3, "Title  One")], "key int, label string")
    hits, trace = cascade.fall_through(index, queries, 5, labels=labels)
    got = {(r["q"], r["stage"], r["key"]) for r in hits.collect()}
    assert got == {
        ("p", "PHRASE", 1), ("t", "TOKEN_AND", 1), ("t", "TOKEN_AND", 2), ("x", "TOKEN_PREFIX", 3), ("s", "CORE_TOKEN_AND", 4), ("e", "EXACT_CLAUSE", 3),
        ("f", "FACT_DECONTAMINATED", 5), ("f", "FACT_DECONTAMINATED", 6),
    }
    steps = {}
    for r in trace.orderBy("ord").collect():
        steps.setdefault(r["q"], []).append((r["stage"], r["hit_count"]))
    assert steps["x"] == [("EXACT_CLAUSE", 0), ("PHRASE", 0), ("TOKEN_AND", 0), ("TOKEN_PREFIX", 1)]
    assert steps["s"][-1] == ("CORE_TOKEN_AND", 1) and steps["e"] == [("EXACT_CLAUSE", 1)]
    assert all(n == 0 for _, n in steps["n"] + steps["k"]) and "HEADING_SCOPED" not in dict(steps["k"])


def test_acceptance_sends_a_query_further(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red ring"), (2, "ring red"), (3, "red gold ring")], DOCS)
    index = inverted_index.build(docs, str(tmp_path / "i"))
    queries = spark.createDataFrame([("a", "red ring", None)], "q string, text string, facts array<string>")
    hits, _ = cascade.fall_through(index, queries, 5, accept=lambda found: found.where("key = 2"))
    assert [(r["stage"], r["key"]) for r in hits.collect()] == [("TOKEN_AND", 2)]
    headings = spark.createDataFrame([(3, "Red ring of gold"), (1, "other")], "key int, heading string")
    last, _ = cascade.fall_through(index, queries.withColumn("text", F.lit("관련 red ring 검토")), 2, headings=headings, accept=lambda found: found.where("key IN (1, 3)"))
    assert {r["stage"] for r in last.collect()} == {"CORE_TOKEN_AND"}


def test_issue_budgets_and_drops(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"alpha beta{k % 3} gamma{k}") for k in range(9)], DOCS)
    index = inverted_index.build(docs, str(tmp_path / "i"))
    rows = [("P", f"i{i}", i, f"r{j}", j, f"q{i}{j}{n}", n, f"beta{(i + j + n) % 3}") for i in range(2) for j in range(2) for n in range(2)]
    requests = spark.createDataFrame(rows, "plan string, issue string, issue_pos int, role string, role_pos int, request string, ord int, text string")
    elements = spark.createDataFrame([(k, n, f"e{k if n else 0}.{n}") for k in range(9) for n in range(3)], "key int, ord int, evidence string")
    policy = RetrievalPolicy(max_queries_per_issue=3, max_candidates_per_role=2, global_candidate_cap=4, max_selected_evidence=6, max_source_elements_per_clause=2)
    b = issue_retrieval.retrieve(index, requests, elements, policy)
    drops = [tuple(r) for r in b.drops.collect()]
    assert sorted(r[2] for r in drops if r[3] == "QUERY_BUDGET") == ["q011", "q111"]
    chosen = b.candidates.orderBy("place").collect()
    assert [r["place"] for r in chosen] == [1, 2, 3, 4] and len({r["key"] for r in chosen}) == 4
    lost = {r[4] for r in drops if r[3] == "CANDIDATE_BUDGET"}
    assert lost and not lost & {r["key"] for r in chosen}
    evidence = [r["evidence"] for r in b.evidence.orderBy("place").collect()]
    assert evidence[0] == "e0.0" and len(evidence) == len(set(evidence)) <= 6
    tried = {r["request"] for r in b.trace.collect()}
    assert tried == {r[5] for r in rows} - {"q011", "q111"}
    doc = issue_retrieval.trace_documents(b).first()
    assert len(doc["candidates"]) == 4 and [d["reason"] for d in doc["drops"]].count("QUERY_BUDGET") == 2 and doc["requests"][0]["attempts"][0]["stage"] == "PHRASE"
    with pytest.raises(ValueError, match="issues"):
        issue_retrieval.retrieve(index, requests, elements, RetrievalPolicy(max_issues=1))


def test_all_channels_of_the_bundle(spark, tmp_path):
    docs = spark.createDataFrame([(1, "gold ring of 1,200 coins"), (2, "goldring and silver"), (3, "제3조 text"), (4, "the red fox ran"), (5, "a vixen ran"), (6, "neighbour"), (7, "table")], DOCS)
    index = inverted_index.build(docs, str(tmp_path / "i"))
    asked = spark.createDataFrame([("a", "gold ring"), ("b", "1200 coins"), ("c", "제3조"), ("d", 'who is "red fox"'), ("e", "fox ran"), ("f", "My  Label"), ("g", "")], "q string, text string")
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    hits = hybrid.bundle(
        index, asked, 3, labels=table([(6, "My Label")], "key int, name string"), clause_ids=table([(3, "제3조"), (2, "제4조")], "key int, name string"), rule_sources=table([("f", 2)], "q string, key int"), links=table([(4, 7)], "source int, target int"),
        places=table([(k, "g", k) for k in range(1, 8)], "key int, group string, pos int"), concepts=table([("fox", "vixen")], "word string, other string"),
    )
    got = {(r["q"], r["channel"], r["key"]) for r in hits.collect()}
    assert {("a", "fts_phrase", 1), ("a", "fts_korean_compound", 2), ("b", "fts_numeric", 1), ("c", "clause_id", 3), ("d", "fts_entity", 4), ("e", "fts_concept", 5), ("e", "linked_visual_table", 7), ("e", "structural_context", 3), ("e", "structural_context", 5), ("f", "structured_exact", 6), ("f", "rule_source", 2)} <= got
    assert not any(q == "g" for q, _, _ in got) and ("e", "structural_context", 4) not in got
    best = {r["q"]: r for r in hybrid.fused(hits, 1).collect()}
    assert best["f"]["key"] == 6 and best["f"]["final_score"] == 1.0 and best["e"]["key"] == 4
