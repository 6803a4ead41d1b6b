"""Clause hierarchy and written references on small texts."""

import random
import re

from veridock.operators import clauses, references

LINES = "revision string, pos int, element string, text string"


def derive(spark, texts, revision="R"):
    rows = [(revision, k, f"e{k}", t) for k, t in enumerate(texts)]
    return clauses.derive_clauses(spark.createDataFrame(rows, LINES)).orderBy("revision", "ord").collect()


def test_articles_paragraphs_and_text(spark):
    got = derive(spark, ["전문", "제3조(정의)", "이 규정에서 쓰는 말.", "① 첫째 ② 둘째", "이어짐", "제3조의2 바로 시작", None, " ", "제4조(둘) ① 하나", "제5조", "부록: 표", "끝"])
    assert [(r["key"], r["title"], r["text"], r["sources"]) for r in got] == [
        ("제3조", "제3조(정의)", "이 규정에서 쓰는 말.", ["e2"]),
        ("제3조#1", "제3조(정의) 제1항", "① 첫째", ["e3"]),
        ("제3조#2", "제3조(정의) 제2항", "② 둘째 이어짐", ["e3", "e4"]),
        ("제3조의2", "제3조의2", "바로 시작", ["e5"]),
        ("제4조#1", "제4조(둘) 제1항", "① 하나", ["e8"]),
        ("APPENDIX:표", "부록: 표", "부록: 표 끝", ["e10", "e11"]),
    ]
    assert got[2]["path"] == ["제3조", "제3조/2"] and got[5]["path"] == ["APPENDIX:표"]


def test_standards_and_their_items(spark):
    got = derive(spark, ["2) 앞", "1-2. 기준", "1) 수", "가) 잎", "가. 글", "다) 잎", "3) 수", "나) 잎", "나. 글", "4) 수", "더", "1-2-3.", "가)"])
    assert [r["key"] for r in got] == ["1-2", "1-2/1", "1-2/1/가", "1-2/가", "1-2/가/다", "1-2/가/3", "1-2/가/3/나", "1-2/나", "1-2/나/4", "1-2-3", "1-2-3/가"]
    assert got[8]["text"] == "수 더" and got[9]["text"] == "1-2-3." and got[3]["path"] == ["1-2", "1-2/가"]


def test_a_standard_with_marks_is_a_paragraph_inside_an_article(spark):
    assert [r["key"] for r in derive(spark, ["제1조 글", "1-1. ① 항", "1-2. 기준", "1-3. ② 항"])] == ["제1조", "제1조#1", "1-2", "1-3"]


def by_hand(texts):
    """The same by walking the lines with a state."""
    out, mode, art, std, letter, number, bare, active = [], None, None, None, None, None, False, False
    for t in texts:
        m = re.match(r"(제\d+조)(\(.\))?\s*(.*)", t)
        marks = re.findall("[①②③][^①②③]*", t)
        if t.startswith("부록"):
            mode, active = "x", True
            out.append("APPENDIX")
        elif m:
            mode, art, bare, active = "a", m[1], not m[3], bool(m[3])
            out += [f"{art}#{'①②③'.index(p[0]) + 1}" for p in re.findall("[①②③][^①②③]*", m[3])] or ([art] if m[3] else [])
        elif mode == "a" and marks:
            out += [f"{art}#{'①②③'.index(p[0]) + 1}" for p in marks]
            active = True
        elif s := re.match(r"(\d+-\d+)\.", t):
            mode, std, letter, number = "s", s[1], None, None
            out.append(std)
        elif mode == "s" and (s := re.match(r"([가-힣])\. ", t)):
            letter, number = s[1], None
            out.append(f"{std}/{letter}")
        elif mode == "s" and (s := re.match(r"(\d+)\) ", t)):
            number = s[1]
            out.append("/".join(x for x in (std, letter, number) if x))
        elif mode == "s" and (s := re.match(r"([가-힣])\) ", t)):
            out.append("/".join(x for x in (std, letter, number, s[1]) if x))
        elif mode == "a" and not active:
            active = True
            out.append(art)
    return out


def test_keys_are_those_of_a_walk(spark):
    rng = random.Random(8)
    forms = ["부록", "제{}조", "제{}조(가) 글", "제{}조 ① 하나 ② 둘", "① 항", "글 ② 항 ③ 항", "{}-1. 기준", "{}-2. ① 표", "가. 글", "나. 글", "{}) 수", "다) 잎", "글"]
    rows, want = [], {}
    for r in range(40):
        texts = [rng.choice(forms).format(rng.randint(1, 3)) for _ in range(rng.randint(1, 25))]
        rows += [(f"R{r:02}", k, f"e{k}", t) for k, t in enumerate(texts)]
        want[f"R{r:02}"] = by_hand(texts)
    rng.shuffle(rows)
    got = {r: [] for r in want}
    for row in clauses.derive_clauses(spark.createDataFrame(rows, LINES)).orderBy("revision", "ord").collect():
        got[row["revision"]].append(row["key"])
    assert got == want


def test_links_of_clauses(spark):
    rows = [("R", k, f"e{k}", t) for k, t in enumerate(["제1조 ① 제2항에 따른다", "② 제1항과 제9항", "제2조 제1항"])]
    made = clauses.derive_clauses(spark.createDataFrame(rows, LINES))
    name = {r["id"]: r["key"] for r in made.collect()}
    got = {(name.get(r["source"], r["source"]), name.get(r["target"], r["target"]), r["relation"]) for r in clauses.clause_links(made).collect()}
    assert got == {
        ("제1조#1", "e0", "source_element"), ("제1조#2", "e1", "source_element"), ("제2조", "e2", "source_element"),
        ("제1조#1", "제1조#2", "next_sibling"), ("제1조#2", "제1조#1", "previous_sibling"),
        ("제1조#1", "제1조#2", "cited_clause"), ("제1조#2", "제1조#1", "cited_clause"), ("e0", "e1", "cited_clause"), ("e1", "e0", "cited_clause"),
    }


def test_references_of_a_text(spark):
    text = "「주택건설기준 등에 관한 규정」 제27조에 따라 「서울특별시 주차장 조례」 제20조제1항 별표 2를, 다시 「주택건설기준 등에 관한 규정」 제27조와 「주차장법」."
    got = references.extract_references(spark.createDataFrame([(1, text), (2, None), (3, "주차장법 제1조")], "id int, text string"), "id", "text").orderBy("id", "ord").collect()
    assert [(r["title"], r["article"], r["paragraph"], r["annex"]) for r in got] == [
        ("주택건설기준 등에 관한 규정", "제27조", None, None), ("서울특별시 주차장 조례", "제20조", "제1항", "별표 2"), ("주차장법", None, None, None),
    ]


def test_references_are_resolved_or_missing(spark):
    documents = spark.createDataFrame([("D1", "주차장법"), ("D2", "주차장법 시행령 (개정)"), ("D3", "국토 계획 법률"), ("D4", "국토계획법률 시행령"), ("D5", "같은 이름"), ("D6", "같은이름")], "document string, title string")
    places = spark.createDataFrame(
        [("D1", "a1", "제19조(설치)", "① 제1항"), ("D1", "a2", "제190조", ""), ("D1", "a3", "", "[제19조의2] 글"), ("D1", "a4", "별표 2", "표"), ("D1", "a5", "별표 21", "표"), *[("D2", f"b{k}", "제6조", "글") for k in range(8)]],
        "document string, evidence string, title string, text string",
    )
    texts = ["「주차장법」 제19조", "「주차장법」 제19조제1항", "「주차장법」 제19조제2항", "「주차장법」 제3조 별표 2", "「법 시행령 (개정)」 제6조", "「주차장법」", "「없는 법」 제1조", "「국토」 제1조", "「같은 이름」 제1조", "「주차장법」 제19조의2", "「주차장법 시행령」 제6조"]
    refs = references.extract_references(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text")
    got = {}
    for r in references.reference_links(refs, documents, places, "id").orderBy("target").collect():
        got.setdefault(r["id"], []).append((r["relation"], r["target"] if r["relation"] == "rule_source" else r["target"].rsplit("-", 1)[0]))
    missing = [("reference_target_missing", "MISSING-REFERENCE")]
    unknown = [("source_not_ingested", "MISSING-SOURCE")]
    assert got == {
        0: [("rule_source", "a1"), ("rule_source", "a3")], 1: [("rule_source", "a1")], 2: missing, 3: [("rule_source", "a4")], 4: [("rule_source", f"b{k}") for k in range(5)],
        5: missing, 6: unknown, 7: unknown, 8: unknown, 9: [("rule_source", "a3")], 10: unknown,
    }
