"""Ingest, finalization, migration, matters and relevance on small tables."""

import json
import random

import pytest


from veridock.operators import matters, migration, relevance
from veridock.sources import ingest
from veridock.sources.ingest import IngestError


def raw(spark, **more):
    rows = {
        "documents": [("d1", "one")],
        "revisions": [("v1", "d1", "h", 9, 2)],
        "pages": [("p1", "v1", 1, 100.0, 50.0, 0.0, 0.0, 0, "MEDIA"), ("p2", "v1", 2, 100.0, 50.0, 0.0, 0.0, 0, "MEDIA")],
        "clauses": [("c1", "v1", "t", "x", "AUTOMATIC")],
        "tables": [],
        "visuals": [],
        "links": [("l1", "c1", "e1", "source_element")],
        "review_flags": [("f1", "c1", "CHECK", "OPEN")],
    } | more
    out = {n: spark.createDataFrame(rows[n], ingest.SCHEMAS[n]) for n in rows if n != "elements"}
    schema = "id string, page_id string, revision_id string, page_number int, element_type string, raw_json string, raw_text string, bbox struct<left:double,bottom:double,right:double,top:double>, parser_order int"
    out["elements"] = spark.createDataFrame(more.get("elements", [("e1", "p1", None, None, "p", "{}", "x", (-1.0, 2.0, 300.0, 60.0), 1), ("e2", None, "v1", 2, "p", "{}", "y", None, 2)]), schema)
    return out


def test_a_snapshot_is_published_whole_and_proved(spark, tmp_path):
    path = str(tmp_path / "s")
    (tmp_path / "s.staging").mkdir()
    said = ingest.ingest(raw(spark), path)
    assert {r["entity"]: r["n_rows"] for r in said.collect()}["elements"] == 2
    done = ingest.validate_finalized(spark, path)
    rows = {r["id"]: r for r in done.tables["elements"].collect()}
    assert rows["e2"]["page_id"] == "p2" and tuple(rows["e1"]["bbox"]) == (0.0, 2.0, 100.0, 50.0) and rows["e2"]["bbox"] is None
    with pytest.raises(FileExistsError):
        ingest.ingest(raw(spark), path)
    spark.createDataFrame([("c1", "v1", "t", "changed", "AUTOMATIC")], ingest.SCHEMAS["clauses"]).write.mode("overwrite").parquet(f"{path}/clauses")
    with pytest.raises(IngestError, match="clauses"):
        ingest.validate_finalized(spark, path)
    with pytest.raises(IngestError, match="never finalized"):
        ingest.validate_finalized(spark, str(tmp_path / "s.staging"))


@pytest.mark.parametrize(
    ("more", "code"),
    [
        ({"elements": [("e1", "p9", None, None, "p", "{}", "x", None, 1)]}, "PAGE_REFERENCE_NOT_FOUND"),
        ({"elements": [("e1", "p1", "v1", 2, "p", "{}", "x", None, 1)]}, "PAGE_REFERENCE_MISMATCH"),
        ({"elements": [("e1", "p1", "v9", None, "p", "{}", "x", None, 1)]}, "PAGE_REFERENCE_MISMATCH"),
        ({"elements": [("e1", "p1", None, None, "p", "{}", "x", None, 1)] * 2}, "DUPLICATE_ID"),
        ({"links": [("l1", "c1", "nothing", "r")]}, "UNKNOWN_TARGET_ID"),
        ({"links": [("l1", None, "c1", "r")]}, "UNKNOWN_SOURCE_ID"),
        ({"documents": [(None, "x"), ("d1", "one")]}, "NULL_ID"),
        ({"revisions": [("v1", "d7", "h", 9, 2)]}, "UNKNOWN_DOCUMENT_ID"),
        ({"pages": [("p1", "v1", 1, 9.0, 9.0, 0.0, 0.0, 0, "M"), ("p2", "v1", 1, 9.0, 9.0, 0.0, 0.0, 0, "M")]}, "DUPLICATE_PAGE_NUMBER"),
        ({"review_flags": [("f1", "zz", "CHECK", "OPEN")]}, "UNKNOWN_ENTITY_ID"),
    ],
)
def test_nothing_is_published_with_broken_references(spark, tmp_path, more, code):
    with pytest.raises(IngestError, match=code):
        ingest.ingest(raw(spark, **more), str(tmp_path / "s"))
    assert list(tmp_path.iterdir()) == []
    with pytest.raises(IngestError, match="no table for links"):
        ingest.ingest({k: v for k, v in raw(spark).items() if k != "links"}, str(tmp_path / "s"))


OLD, NEW = "id string, text string, status string", "id string, text string, status string"


def test_rounds_use_rows_up(spark):
    old = spark.createDataFrame([("a1", "x", "S"), ("a2", "x", "T"), ("a3", "x", "T"), ("a4", "y", None), ("a5", "z", "S"), ("a6", "w", "S")], OLD)
    new = spark.createDataFrame([("b1", "x", "S"), ("b2", "x", "U"), ("b3", "x", "V"), ("b4", "y", None), ("b5", "z", "Q"), ("b6", "w", "S"), ("b7", "w", "S")], NEW)
    got = migration.match_rounds(old, new, [["text", "status"], ["text"]])
    assert {tuple(r) for r in got.collect()} == {("a1", "b1", 1), ("a4", "b4", 1), ("a2", "b2", 2), ("a3", "b3", 2), ("a5", "b5", 2)}
    strict = migration.match_rounds(old, new, [["text", "status"]])
    codes = {r["id"]: (r["code"], r["candidate"]) for r in migration.unresolved(old, new, strict, ["text"], ["status"]).collect()}
    assert codes == {"a2": ("AMBIGUOUS", None), "a3": ("AMBIGUOUS", None), "a5": ("REVIEWED_VALUE_CONFLICT", "b5"), "a6": ("AMBIGUOUS", None)}


def test_a_migration_rewrites_all_references_and_proves_it(spark):
    clauses = spark.createDataFrame([(f"{s}{k}", f"t{k}", "A") for s in "LR" for k in range(6)], OLD)
    links = spark.createDataFrame([(f"k{k}", f"L{k % 6}", f"R{(k + 1) % 6}", k) for k in range(30)], "id string, source_id string, target_id string, weight int")
    notes = spark.createDataFrame([("n1", "L2"), ("n2", None), ("n3", "elsewhere")], "id string, clause string")
    old, new = clauses.where("id LIKE 'L%'"), clauses.where("id LIKE 'R%'")
    matches = migration.match_rounds(old, new, [["text", "status"]])
    none = migration.unresolved(old, new, matches, ["text"], ["status"])
    made = migration.migrate({"clauses": clauses, "links": links, "notes": notes}, {"links": ["source_id", "target_id"], "notes": ["clause"]}, "clauses", matches, none)
    assert made.proof.where("NOT holds").count() == 0 and made.proof.count() == 8
    assert made.tables["clauses"].count() == 6
    assert {(r["id"], r["source_id"], r["target_id"], r["weight"]) for r in made.tables["links"].collect()} == {(f"k{k}", f"R{k % 6}", f"R{(k + 1) % 6}", k) for k in range(30)}
    assert {tuple(r) for r in made.tables["notes"].collect()} == {("n1", "R2"), ("n2", None), ("n3", "elsewhere")}
    short = migration.unresolved(old, new.where("id <> 'R3'"), migration.match_rounds(old, new.where("id <> 'R3'"), [["text"]]), ["text"], ["status"])
    with pytest.raises(ValueError, match="L3 is MISSING"):
        migration.migrate({"clauses": clauses}, {}, "clauses", matches, short)


def event(matter, sequence, kind, expected=None, **payload):
    return (matter, sequence, expected, kind, json.dumps(payload))


ISSUE = {"question": "q", "work_state": "OPEN", "depends_on": []}


def random_events(rng, matter, n):
    out = []
    for s in range(1, n + 1):
        k, i = rng.randint(0, 6), f"i{rng.randint(0, 3)}"
        expected = rng.choice([None, None, None, 0, 1, 2, 3])
        made = [
            event(matter, s, "TITLE_CHANGED", expected, title=f"t{s}"), event(matter, s, "ISSUE_ADDED", expected, issue_id=i, **(ISSUE | {"depends_on": rng.choice([[], ["i0"]])})),
            event(matter, s, "ISSUE_STATE_CHANGED", expected, issue_id=i, work_state=f"s{s}"), event(matter, s, "ISSUE_REQUIRED_FACETS_SET", expected, issue_id=i, required_facet_ids=["f"]),
            event(matter, s, "SOURCE_BOUND", expected, source_id=i, sha256="h"), event(matter, s, "SOURCE_UNBOUND", expected, source_id=i), event(matter, s, "ODD", expected),
        ]
        out.append(made[k])
    return out


def test_what_events_change_and_why_they_are_refused(spark):
    rows = [
        event("m", 1, "TITLE_CHANGED", 0, title="A"), event("m", 2, "ISSUE_ADDED", 1, issue_id="i", **ISSUE), event("m", 3, "ISSUE_ADDED", 2, issue_id="i", **ISSUE), event("m", 4, "ISSUE_ADDED", 2, issue_id="j", **(ISSUE | {"depends_on": ["x"]})),
        event("m", 5, "ISSUE_STATE_CHANGED", 2, issue_id="i", work_state="DONE"), event("m", 6, "TITLE_CHANGED", 2, title="B"), event("m", 7, "TITLE_CHANGED", 3, title="C", more=1), event("m", 8, "SOURCE_BOUND", 3, source_id="s", sha256="h"),
        event("m", 9, "SOURCE_BOUND", 4, source_id="s", sha256="h"), event("m", 10, "ISSUE_REQUIRED_FACETS_SET", 4, issue_id="i", required_facet_ids=["a", "a"]), event("m", 11, "ISSUE_REQUIRED_FACETS_SET", 4, issue_id="i", required_facet_ids=["a"]),
        event("m", 12, "ISSUE_REQUIRED_FACETS_SET", 5, issue_id="i", required_facet_ids=["b"]), event("m", 13, "NO_KIND", 5), ("m", 14, 5, "TITLE_CHANGED", "{bad"), ("m", 15, 5, "TITLE_CHANGED", "[" * 100_000), event("m", 17, "TITLE_CHANGED", 5, title="D"),
        event("m", 16, "SOURCE_UNBOUND", 5, source_id="q"), event("n", 2, "TITLE_CHANGED", 0, title="late"), (None, 1, None, "TITLE_CHANGED", "{}"),
    ]
    got = matters.fold(spark.createDataFrame(rows, matters.EVENTS)).collect()
    codes = {(r["matter"], r["sequence"]): r["code"] for r in got}
    assert [codes[("m", s)] for s in range(1, 18)] == [
        None, None, "DUPLICATE_ISSUE", "UNKNOWN_DEPENDENCY", None, "REVISION_MISMATCH", "INVALID_PAYLOAD", None, "DUPLICATE_SOURCE", "INVALID_PAYLOAD", None, "FACETS_ALREADY_SET", "UNKNOWN_KIND", "INVALID_PAYLOAD", "INVALID_PAYLOAD", "UNKNOWN_SOURCE", None,
    ]
    state = json.loads(next(r["state"] for r in got if r["matter"] == "m" and r["state"]))
    assert state["title"] == "D" and state["revision"] == 6 and state["issues"]["i"]["work_state"] == "DONE" and state["sources"] == {"s": "h"}
    assert codes[("n", 2)] == "SEQUENCE_GAP" and len(got) == len(rows) - 1
    assert matters.fold(spark.createDataFrame([], matters.EVENTS)).count() == 0


def test_snapshot_and_stream_give_the_rows_of_the_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [e for m in "abcd" for e in random_events(rng, m, 30)]
    plain = lambda df: sorted(((r["matter"], r["sequence"], r["accepted"], r["code"], r["revision"]) for r in df.collect()), key=repr)
    whole = matters.fold(spark.createDataFrame(rows, matters.EVENTS))
    early, late = (spark.createDataFrame([r for r in rows if (r[1] <= 12) == first and not (r[0] == "d" and not first)], matters.EVENTS) for first in (True, False))
    first = matters.fold(early)
    snapshot = matters.states(first)
    second = matters.fold(late, snapshot)
    want = [r for r in plain(whole) if not (r[0] == "d" and r[1] > 12)]
    assert sorted(plain(first) + plain(second), key=repr) == want
    ends = dict(matters.states(second, snapshot).collect())
    full = dict(matters.states(matters.fold(spark.createDataFrame([r for r in rows if not (r[0] == "d" and r[1] > 12)], matters.EVENTS))).collect())
    assert ends == full and set(ends) == set("abcd")
    for part, df in (("1", early), ("2", late)):
        df.coalesce(1).write.parquet(str(tmp_path / "in" / part))
    source = spark.readStream.schema(matters.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = matters.stream_fold(source).writeStream.format("memory").queryName("matter_verdicts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = plain(spark.table("matter_verdicts"))
    assert len(got) == len(want) and {r[:2] for r in got} == {r[:2] for r in want}


def test_anchors_are_found_at_once(spark, monkeypatch):
    texts = [(1, "The Red  Fox"), (2, "ab abc c"), (3, None), (4, "역세권의 간선도로변")]
    df, anchors = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([("red fox",), ("AB",), ("abc",), ("c",), ("역세권",), ("",), ("no",)], "anchor string")
    want = {(1, "red fox"), (2, "ab"), (2, "abc"), (2, "c"), (4, "역세권")}
    assert {tuple(r) for r in relevance.anchor_hits(df, "id", "text", anchors).collect()} == want
    monkeypatch.setattr(relevance, "MAX_ANCHORS", 2)
    assert {tuple(r) for r in relevance.anchor_hits(df, "id", "text", anchors).collect()} == want
    assert relevance.anchor_hits(df, "id", "text", anchors.limit(0)).count() == 0


def test_relevance_of_clauses(spark):
    queries = spark.createDataFrame([("a", "역세권 기준은?", "최소 면적"), ("b", "다른 질문", "공공기여 산정"), ("c", "제3조 높이 질문", "높이"), ("d", "역세권 간선도로변", "높이")], "q string, question string, text string")
    clauses = spark.createDataFrame([(1, "대지면적", "역세권"), (2, "면적", "간선도로변의 최소 면적"), (3, "제목", "아무 글"), (4, "공공기여", "부담 비율"), (5, "제3조 높이", ""), (6, None, "간선도로변")], "key int, title string, text string")
    pairs = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 3), ("c", 5), ("c", 6), ("d", 6)], "q string, key int")
    got = {(r["q"], r["key"]): (r["accepted"], r["codes"]) for r in relevance.judge(pairs, queries, clauses).collect()}
    assert got == {
        ("a", 1): (True, ["ACCEPT_SUBJECT_MATCH"]), ("a", 2): (False, ["REJECT_SUBJECT_CONFLICT"]), ("a", 3): (False, ["REJECT_REQUIRED_ANCHOR_MISSING"]), ("b", 4): (True, ["ACCEPT_SECTION_MATCH"]),
        ("b", 3): (False, ["RETRIEVAL_RELEVANCE_INSUFFICIENT"]), ("c", 5): (True, ["ACCEPT_SECTION_MATCH"]), ("c", 6): (True, ["ACCEPT_NO_DETERMINISTIC_CONFLICT"]), ("d", 6): (True, ["ACCEPT_SUBJECT_MATCH"]),
    }
