"""Operators on small literal tables: golden cases, edges and invariants."""

import json
import random

import pytest
from pyspark.sql import functions as F

from veridock.functions import geometry, numbers, text
from veridock.functions.canonical import canonical_json, sorted_map_json
from veridock.operators import budgets, eventlog, graph, lineage, review, rules, search, segments
from veridock.sources import evidence
from veridock.sources.session import ensure_checkpoint_dir


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"] if values else spark.range(1).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, text.collapse(F.col("s")), s="  a　 b\n c ") == "a b c"
    assert one(spark, text.normalize_text(F.col("s")), s="é  x") == "é x"
    assert one(spark, text.match_text(F.col("s")), s="Ａß") == "ass"
    assert one(spark, text.tokens(F.col("s")), s="Ab-c, äx 12") == ["ab", "c", "äx", "12"]
    assert one(spark, text.compounds(text.tokens(F.col("s"))), s="a b c") == ["ab", "bc", "abc"]
    assert one(spark, text.sub_queries(text.tokens(F.col("s"))), s="a b c") == ["b c", "a c", "a b"]
    assert one(spark, text.heading_slug(F.col("s")), s="Hello, World x") == "hello-world-x"
    assert one(spark, text.strip_suffix(F.col("s"), ["ing", "g"]), s="testing") == "test"
    assert one(spark, text.grouped_number(F.col("s")), s="1,200") == ["1200", "1,200"]


@pytest.mark.parametrize(
    ("line", "tokens"),
    [
        ("1,234.5 and -7%", ["1,234.5", "-7%"]),
        ("v1 x_2 3m 4 km", ["3", "4"]),
        ("1,23 and 12,345,678", ["23", "12,345,678"]),
        ("제3종 5", ["5"]),
        ("a-1 +2", ["+2"]),
        ("", []),
    ],
)
def test_numeric_tokens(line, tokens):
    assert [t for t, _, _ in numbers.numeric_spans(line)] == tokens


def test_unsupported_numbers():
    assert numbers.unsupported_span("x 1e5") == (2, 5)
    assert numbers.unsupported_span("about .5") == (6, 8)
    assert numbers.unsupported_span("1_000") == (0, 5)
    assert numbers.unsupported_span("Ⅷ") == (0, 1)
    assert numbers.unsupported_span("12 and 1,000") is None


@pytest.mark.parametrize(
    ("line", "span"),
    [
        ("1.2.3", (0, 1)), ("1..2", (0, 1)), ("5-6", (2, 3)), ("1,000-2,000", (6, 7)), ("x 12,34 y", (2, 7)), ("1,23,456", (0, 8)), ("12,345.", (0, 6)), ("값은 １２３이다.", (3, 6)),
        ("10²", (2, 3)), ("1E-3", (0, 4)), ("제2종 구역 10m² R1 DOC-7 v1.2.3", None), ("10m-5", None), ("+3 -12 12.50% 1,000㎡ 0.5미터", None), ("", None),
    ],
)
def test_what_is_no_number_is_refused(line, span):
    assert numbers.unsupported_span(line) == span


def test_numbers_as_columns(spark):
    line = "제2종 1,000-2 of -5 m², a1 7.50% 3."
    row = spark.createDataFrame([(line,), (None,)], "t string").select(numbers.numeric_texts(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in row] == [[t for t, _, _ in numbers.numeric_spans(line)], None]


def test_numbers_take_linear_time():
    import time

    began = time.perf_counter()
    for part in ("1.1", "1,", "1_", "7", "제1종", "1e1 "):
        numbers.unsupported_span(part * 50_000)
    assert time.perf_counter() - began < 10


def test_measures_and_conditional_range(spark):
    rule = "높이 20m 이하. " + "x" * 90 + " 다만 30m 까지"
    df = spark.createDataFrame([("25 m", rule), ("35 m", rule), ("25 %", rule)], "fact string, rule string")
    made = df.select(numbers.measures("fact").alias("f"), numbers.measures("rule").alias("r")).select(numbers.conditional_range(F.col("f"), F.col("r")).alias("x"), "r")
    rows = made.collect()
    assert [r["x"] for r in rows] == [True, False, False]
    assert [m["conditional"] for m in rows[0]["r"]] == [False, True]


def test_decimals(spark):
    assert one(spark, numbers.decimal_text(F.col("s").cast("decimal(10,4)")), s="1.2500") == "1.25"
    assert one(spark, numbers.decimal_text(F.col("s").cast("decimal(10,0)")), s="100") == "100"
    assert one(spark, numbers.compare_tokens(F.col("a"), F.col("b")), a="1,000", b="999.9%") == "GREATER"
    assert one(spark, numbers.relation_holds(F.lit(1), F.lit("lte"), F.lit(1))) is True


def test_canonical(spark):
    assert one(spark, canonical_json(b=F.lit(1), a=F.lit("x"))) == '{"a":"x","b":1}'
    assert one(spark, canonical_json(b=F.lit(None).cast("int"), a=F.lit("x"))) == '{"a":"x","b":null}'
    assert one(spark, sorted_map_json(F.create_map(F.lit("z"), F.lit(1), F.lit("a"), F.lit(2)))) == '{"a":2,"z":1}'


@pytest.mark.parametrize("turn", [0, 90, 180, 270])
def test_boxes_round_trip(spark, turn):
    b = F.struct(F.lit(10.0).alias("left"), F.lit(20.0).alias("bottom"), F.lit(30.0).alias("right"), F.lit(50.0).alias("top"))
    there = geometry.normalize_box(b, F.lit(200.0), F.lit(100.0), F.lit(turn))
    back = geometry.project_box(there, F.lit(200.0), F.lit(100.0), F.lit(turn))
    assert one(spark, back).asDict() == {"left": 10.0, "bottom": 20.0, "right": 30.0, "top": 50.0}


def test_clamp_and_bounds(spark):
    b = F.struct(F.lit(-0.005).alias("left"), F.lit(0.0).alias("bottom"), F.lit(30.0).alias("right"), F.lit(100.0).alias("top"))
    assert one(spark, geometry.clamp_box(b, F.lit(30.0), F.lit(100.0), 0.01)).left == 0.0
    assert one(spark, geometry.clamp_box(b, F.lit(20.0), F.lit(100.0), 0.01)) is None
    assert one(spark, geometry.path_bounds(F.array(F.array(F.lit(1.0), F.lit(5.0)), F.array(F.lit(3.0), F.lit(2.0))))).top == 5.0


def test_fusion_ignores_order_and_rejects_unknown_channels(spark):
    hits = [("a", "fts_phrase", 1.0), ("a", "fts_phrase", 0.5), ("b", "fts_token_and", 1.0), ("a", "fts_concept", 0.2)]
    expected = {"a": 0.57, "b": 0.15}
    for seed in range(3):
        random.Random(seed).shuffle(hits)
        got = search.fuse(spark.createDataFrame(hits, "id string, channel string, score double"), "id").collect()
        assert {r["id"]: r["final_score"] for r in got} == expected
    with pytest.raises(Exception, match="no weight"):
        search.fuse(spark.createDataFrame([("a", "clause_exact", 1.0)], "id string, channel string, score double"), "id").collect()


def test_traversal_budgets(spark):
    links = [("s", f"n{i}", "exception" if i == 9 else "visual") for i in range(10)] + [("n9", "s", "parent"), ("n9", "m1", "parent"), ("n9", "gone", "cited_clause")]
    known = [(f"n{i}", True, None) for i in range(10)] + [("m1", True, "STALE_SAME_DOCUMENT_REVISION")]
    args = (spark.createDataFrame([(1, "s")], "query int, node string"), spark.createDataFrame(links, "source string, target string, relation string"), spark.createDataFrame(known, "node string, is_known boolean, stale string"))
    rows = graph.traverse(*args, depth=2, max_nodes=4, max_fanout=3).collect()
    found = {(r["target"], r["depth"]) for r in rows if r["found"]}
    assert found == {("n9", 1), ("n0", 1), ("n1", 1)}
    assert {r["target"] for r in rows if not r["found"]} == {"m1", "gone"}
    assert sum(r["found"] for r in graph.traverse(*args, depth=1, max_nodes=2, max_fanout=6).collect()) == 2
    with pytest.raises(ValueError):
        graph.traverse(*args, depth=4)


def test_closure_of_a_cycle(spark):
    ensure_checkpoint_dir(spark)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "source string, target string")
    assert {r["node"] for r in graph.closure(edges, spark.createDataFrame([("a",)], "node string")).collect()} == {"a", "b", "c"}


def test_round_robin_and_first_come(spark):
    req = spark.createDataFrame([(1, "r1", 0, "a", 1), (1, "r1", 0, "b", 2), (1, "r1", 0, "c", 3), (1, "r2", 1, "d", 1), (1, "r2", 1, "e", 2)], "issue int, role string, role_pos int, request string, ord int")
    rows = budgets.requests_for_issues(req).orderBy("place").collect()
    assert [r["request"] for r in rows] == ["a", "d", "b", "e", "c"]
    assert rows[-1]["reason"] == "QUERY_BUDGET"
    pairs = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "x"), (1, 4, "z")], "g int, ord int, evidence string")
    assert [r["evidence"] for r in budgets.first_come(pairs, ["g"], 2).orderBy("place").collect()] == ["x", "y"]


def test_segments(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(["pre", "# A", "a1", "# A", "b1"])], "g int, pos int, line string")
    marked = segments.segment(df, ["g"], "pos", F.col("line").startswith("#"))
    assert [r["text"] for r in segments.fold_segments(marked, ["g"], "pos", "line").orderBy("segment").collect()] == ["pre", "# A\na1", "# A\nb1"]
    heads = segments.heading_anchors(df.where(F.col("line").startswith("#")), ["g"], "pos", "line")
    assert [r["anchor"] for r in heads.orderBy("pos").collect()] == ["-a", "-a-1"]


def test_coverage_precedence(spark):
    base = dict.fromkeys(["conflicting", "ambiguous", "source_missing", "reference_missing", "relevance_insufficient", "conditional"], False)
    cases = [
        ({"conflicting": True, "ambiguous": True}, ["rule"], [], "CONFLICT", ["CONFLICTING_RULES"]),
        ({"ambiguous": True}, ["rule"], [], "UNRESOLVED", ["AMBIGUOUS_RULE"]),
        ({"source_missing": True, "relevance_insufficient": True}, ["rule"], [], "SOURCE_MISSING", ["SOURCE_NOT_INGESTED", "RELEVANCE_INSUFFICIENT"]),
        ({"relevance_insufficient": True}, ["rule"], [], "UNRESOLVED", ["RELEVANCE_INSUFFICIENT"]),
        ({}, [], [], "UNRESOLVED", ["RETRIEVAL_MISS"]),
        ({}, ["rule"], ["f"], "UNRESOLVED", ["MISSING_REQUIRED_FACET"]),
        ({"conditional": True}, ["rule"], [], "CONDITIONAL", []),
        ({}, ["rule"], [], "RESOLVED", []),
    ]
    for flags, cited, facets, status, gaps in cases:
        row = {**base, **flags, "issue": 1, "required": ["rule"], "semantic": [], "cited": cited, "missing_facets": facets}
        schema = ", ".join([f"{k} boolean" for k in base] + ["issue int", *[f"{c} array<string>" for c in ("required", "semantic", "cited", "missing_facets")]])
        got = review.issue_coverage(spark.createDataFrame([row], schema)).first()
        assert (got["status"], got["gaps"]) == (status, gaps)


def test_confidence_weights_and_levels(spark):
    assert sum(round(float(w) * 100) for w in review.FACTOR_WEIGHTS.values()) == 100
    rows = [("r", n, "1", "human" if n == "human review status" else "x", 0) for n in review.FACTOR_WEIGHTS]
    schema = "run string, name string, value string, source string, failures int"
    got = review.confidence(spark.createDataFrame(rows, schema), "run").first()
    assert (str(got["score"]), got["level"]) == ("1.0000", "HIGH")
    pending = [(r, n, v, "human_review:pending" if n == "human review status" else s, f) for r, n, v, s, f in rows]
    assert review.confidence(spark.createDataFrame(pending, schema), "run").first()["level"] == "MEDIUM"
    with pytest.raises(Exception, match="confidence factors"):
        review.confidence(spark.createDataFrame(rows[:-1], schema), "run").collect()


def test_gates_in_order(spark):
    flags = {"unapproved_rule": F.lit(True), "missing_required_input": F.lit(True)}
    assert one(spark, review.abstention_reasons(F.lit(0.5), flags)) == ["MISSING_REQUIRED_INPUT", "UNAPPROVED_RULE", "LOW_CONFIDENCE"]


def test_readiness_ladder(spark):
    rows = [("a", 1, None, None), ("b", 2, "REFERENCE", "PENDING_PARSER_OUTPUT"), ("b", 3, "CASE_DRAWING", "PENDING_DRAWING_INGESTION"), ("c", 4, "REFERENCE", "FAILED"), ("d", 5, "SUPPORTING_IMAGE", "BLOCKED")]
    got = review.review_readiness(spark.createDataFrame(rows, "run string, attachment int, role string, state string"), "run").collect()
    assert {r["run"]: (r["state"], r["pending"]) for r in got} == {"a": ("ROLE_CONFIRMATION_REQUIRED", ["1"]), "b": ("PENDING_REFERENCE_INGESTION", ["2"]), "c": ("BLOCKED", []), "d": ("READY_TO_EVALUATE", [])}


@pytest.mark.parametrize(
    ("f", "p", "t", "expected"),
    [
        ("10", "80", "0.125", ("SUCCESS", None, "0.125", "12.5%", "AT_THRESHOLD")),
        ("9.99", "80", "0.125", ("SUCCESS", None, "0.124875", "12.488%", "BELOW_THRESHOLD")),
        ("-1", "0", "0.1", ("DIVISION_BY_ZERO", "DIVISION_BY_ZERO", None, None, None)),
        ("-1", "5", "0.1", ("INVALID_INPUT", "NEGATIVE_VALUE", None, None, None)),
        ("x", "5", "0.1", ("INVALID_INPUT", "INVALID_DECIMAL", None, None, None)),
        (None, "5", "0.1", ("INVALID_INPUT", "MISSING_INPUT", None, None, None)),
    ],
)
def test_frontage_ratio(spark, f, p, t, expected):
    df = spark.createDataFrame([(f, p, t)], "f string, p string, t string")
    assert tuple(df.select(rules.frontage_ratio(F.col("f"), F.col("p"), F.col("t")).alias("x")).first()["x"]) == expected


def test_rules(spark):
    rule = rules.Rule("R", "1", {"a": ("integer", True), "b": ("string", False)}, {"any": [{"exists": {"input": "b"}}, {"compare": {"operator": "gt", "left": {"input": "a"}, "right": {"value": "3"}}}]})
    assert rules.validate_rule(rule) == []
    df = spark.createDataFrame([(1, 5, None), (2, 1, None), (3, None, "x"), (4, 1, "x")], "id int, a long, b string")
    made = rules.evaluate(rule, {"a": F.col("a"), "b": F.col("b")}, present={"a": F.col("a").isNotNull(), "b": F.lit(True)})
    assert [r["s"] for r in df.select("id", made["status"].alias("s")).orderBy("id").collect()] == ["SATISFIED", "NOT_SATISFIED", "INDETERMINATE", "SATISFIED"]
    mixed = rules.Rule("M", "1", {"a": ("integer", True), "b": ("string", True)}, {"compare": {"operator": "gt", "left": {"input": "a"}, "right": {"input": "b"}}})
    made = rules.evaluate(mixed, {"a": F.lit(1), "b": F.lit("x")})
    assert spark.range(1).select(made["reason"].alias("r")).first()["r"] == "INVALID_RULE_INPUT"
    with pytest.raises(ValueError):
        rules.register_formula("FRONTAGE_RATIO", "1", rules.frontage_ratio)


def test_lineage(spark):
    left = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, fp string")
    right = spark.createDataFrame([(10, "x"), (11, "x"), (12, "x")], "id int, fp string")
    got = {(r["left_id"], r["right_id"], r["code"]) for r in lineage.match_fingerprints(left, right, "id", "fp").collect()}
    assert got == {(1, 10, "AMBIGUOUS"), (2, 11, "AMBIGUOUS"), (3, None, "MISSING")}
    a, b = spark.createDataFrame([("k1", 1), ("k2", 2)], "k string, v int"), spark.createDataFrame([("k2", 3), ("k3", 4)], "k string, v int")
    assert {(r["k"], r["kind"]) for r in lineage.structural_diff(a, b, ["k"], "v").collect()} == {("k1", "REMOVED"), ("k2", "CHANGED"), ("k3", "ADDED")}


def test_citations(spark):
    box = "struct<left:double,bottom:double,right:double,top:double>"
    ev = spark.createDataFrame([("e1", "d", "r", 1, (0.0, 0.0, 1.0, 1.0), "h")], f"evidence_id string, document_id string, revision_id string, page_number int, bbox {box}, source_hash string")
    cit = spark.createDataFrame(
        [("c1", "e1", "d", "r", 1, (0.005, 0.0, 1.0, 1.0), "h"), ("c2", "e1", "d", "r2", 1, (0.5, 0.0, 1.0, 1.0), "h"), ("c3", "e9", "d", "r", 1, None, "h")],
        f"citation_id string, evidence_id string, document_id string, revision_id string, page_number int, bbox {box}, source_hash string",
    )
    assert {r["citation_id"]: r["codes"] for r in lineage.resolve_citations(cit, ev).collect()} == {"c1": [], "c2": ["REVISION_MISMATCH", "BBOX_MISMATCH"], "c3": ["EVIDENCE_NOT_FOUND"]}


def test_transitions(spark):
    rows = [(None, "RECEIVED", "TRANSITION", None), (None, "FAILED", "TRANSITION", "INITIAL_MUST_ENTER_RECEIVED"), ("BLOCKED", "RUNNING_MATH", "RESUME", None), ("BLOCKED", "FAILED", "TRANSITION", "RESUME_REQUIRED"), ("FAILED", "RECEIVED", "RESUME", "TERMINAL_STATE"), ("RUNNING_MATH", "RUNNING_RULES", "RESUME", "RESUME_ONLY_AFTER_BLOCKED"), ("RECEIVED", "FINALIZING", "TRANSITION", "TRANSITION_NOT_ALLOWED")]
    df = spark.createDataFrame(rows, "p string, n string, k string, want string")
    for r in df.select("want", eventlog.transition_error(F.col("p"), F.col("n"), F.col("k")).alias("got")).collect():
        assert r["want"] == r["got"]


def test_csv_and_aliases(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("﻿Clause_ID,Title\n1,\n2,two\n".encode())
    df = evidence.read_csv(spark, str(tmp_path / "x.csv"))
    got = df.select(evidence.first_of(df, "id", "clause_id").alias("id"), evidence.first_of(df, "name", "title").alias("t")).collect()
    assert [tuple(r) for r in got] == [("1", ""), ("2", "two")]


def test_publish_read_migrate(spark, tmp_path):
    tables = {n: spark.createDataFrame([], s) for n, s in evidence.SCHEMAS.items()}
    evidence.publish(tables, str(tmp_path / "snap"))
    assert evidence.schema_version(evidence.read_evidence(spark, str(tmp_path / "snap"))) == 4
    with pytest.raises(FileExistsError):
        evidence.publish(tables, str(tmp_path / "snap"))
    old = {**tables, "clauses": tables["clauses"].drop("review_status"), "pages": tables["pages"].drop("origin_x", "origin_y", "rotation", "box_kind")}
    assert evidence.schema_version(old) == 2
    assert evidence.schema_version(evidence.migrate(old)) == 4
    with pytest.raises(ValueError):
        evidence.schema_version({"documents": tables["documents"]})
    assert {r["n_rows"] for r in evidence.snapshot_digest(tables).collect()} == {0}


def test_inventory_and_tree(spark, tmp_path):
    tree = {"type": "doc", "kids": [{"type": "paragraph", "page number": 2, "content": "b", "bounding box": [0, 0, 1, 1]}, {"type": "heading", "page number": 1, "content": "a", "kids": [{"type": "span", "page number": 1, "content": "c"}]}]}
    (tmp_path / "t.json").write_text(json.dumps(tree))
    (tmp_path / "p.pdf").write_bytes(b"%PDF-1.7")
    inv = {r["path"].rsplit("/", 1)[1]: (r["category"], r["mime"]) for r in evidence.inventory(spark, str(tmp_path)).collect()}
    assert inv == {"t.json": ("parser_output", None), "p.pdf": ("source", "application/pdf")}
    files = spark.createDataFrame([(json.dumps(tree),)], "content string")
    got = [(r["page_number"], r["parser_order"], r["text"]) for r in evidence.tree_elements(files, "D", "R").collect()]
    assert sorted(got) == [(1, 1, "a"), (1, 2, "c"), (2, 1, "b")]


def test_table_cells(spark):
    schema = "table_id string, rows array<struct<row_number:int,cells:array<struct<column_number:int,row_span:int,column_span:int,text:string>>>>"
    df = spark.createDataFrame([("t", [(2, [(1, None, 2, "c")]), (1, [(2, None, None, "b"), (1, None, None, "a")])])], schema)
    assert df.select(evidence.table_text(F.col("rows")).alias("x")).first()["x"] == "a\tb\nc"
    assert {(r["row_number"], r["column_number"], r["column_span"]) for r in evidence.table_cells(df).collect()} == {(2, 1, 2), (1, 2, 1), (1, 1, 1)}


def test_sanitize(spark):
    assert one(spark, evidence.sanitize(F.col("s")), s="token: abc /home/me/x http://localhost:80/a") == "token=[REDACTED] [PATH] [LOOPBACK]"
