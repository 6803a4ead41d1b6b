"""Golden cases, approvals, manifests, and packets of runs on small tables."""

import hashlib
import json

from veridock.operators import governance, packets
from veridock.operators.rules import Rule

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
RULES = [
    Rule("R1", "1", {"area": ("decimal", True)}, {"compare": {"left": {"input": "area"}, "operator": "gte", "right": {"value": "100"}}}),
    Rule("R2", "1", {"zone": ("string", False)}, {"exists": {"input": "zone"}}),
]


def cases(spark):
    rows = [("R1", "1", "a", {"area": "120"}, "SATISFIED"), ("R1", "1", "b", {"area": "80"}, "NOT_SATISFIED"), ("R1", "1", "c", {}, "INDETERMINATE"), ("R2", "1", "a", {"zone": "x"}, "SATISFIED"), ("R2", "1", "b", {"zone": "x"}, "NOT_SATISFIED"), ("R9", "1", "a", {}, "SATISFIED")]
    return spark.createDataFrame(rows, "rule_id string, version string, case string, inputs map<string,string>, expected string")


def texts(spark, rows):
    return spark.createDataFrame(rows, "rule_id string, version string, text string")


def test_golden_cases(spark):
    got = {(r["rule_id"], r["case"]): (r["actual"], r["passed"]) for r in governance.golden_results(RULES, cases(spark)).collect()}
    assert got == {("R1", "a"): ("SATISFIED", True), ("R1", "b"): ("NOT_SATISFIED", True), ("R1", "c"): ("INDETERMINATE", True), ("R2", "a"): ("SATISFIED", True), ("R2", "b"): ("SATISFIED", False), ("R9", "a"): (None, False)}


def test_approvals_hold_or_say_what_breaks(spark):
    held = texts(spark, [("R1", "1", "one"), ("R2", "1", "two"), ("R3", "1", "three")])
    reports = governance.golden_reports(governance.golden_results(RULES, cases(spark)), held)
    report = {r["rule_id"]: r for r in reports.collect()}
    assert set(report) == {"R1", "R2"} and (report["R1"]["n_cases"], report["R1"]["n_passed"]) == (3, 3)
    rows = [
        ("ok", "R1", "1", sha("one"), sha("one"), report["R1"]["report_hash"], "ann", "2026-01-01"), ("failed", "R2", "1", sha("two"), sha("two"), report["R2"]["report_hash"], "ann", "2026-01-01"),
        ("untested", "R3", "1", sha("three"), sha("three"), "x", " ", None), ("wrong", "R1", "1", sha("x"), sha("one"), "y", "ann", "2026-01-01"), ("unknown", "R8", "1", "a", "b", "c", "ann", "2026-01-01"),
    ]
    approvals = spark.createDataFrame(rows, "approval string, rule_id string, version string, candidate_hash string, approved_hash string, report_hash string, reviewer string, reviewed_at string")
    verified = governance.verify_approvals(approvals, held, held, reports)
    codes = {r["approval"]: r["codes"] for r in verified.collect()}
    assert codes == {
        "ok": [], "failed": ["GOLDEN_FAILED"], "untested": ["REVIEWER_MISSING", "REVIEW_DATE_MISSING", "GOLDEN_MISSING"], "wrong": ["CANDIDATE_HASH_MISMATCH", "GOLDEN_HASH_MISMATCH"],
        "unknown": ["CANDIDATE_MISSING", "APPROVED_MISSING", "GOLDEN_MISSING"],
    }
    changed = governance.verify_approvals(approvals.where("approval = 'ok'"), held, texts(spark, [("R1", "1", "other")]), reports).first()["codes"]
    assert changed == ["APPROVED_HASH_MISMATCH", "APPROVED_DIFFERS_FROM_CANDIDATE", "GOLDEN_OF_OTHER_TEXT"]
    manifest, findings = governance.active_manifest(verified)
    assert [tuple(r) for r in manifest.collect()] == [("R1", "1", sha("one"), "ok")]
    assert findings.where("rule_id = 'R2'").first()["code"] == "GOLDEN_FAILED"


def test_versions_conflict_and_promotion_never_overwrites(spark):
    rows = [("a1", "R1", "1", "h1", []), ("a2", "R1", "2", "h2", []), ("a3", "R2", "1", "h3", []), ("a4", "R2", "1", "h3", [])]
    verified = spark.createDataFrame(rows, "approval string, rule_id string, version string, approved_hash string, codes array<string>")
    manifest, findings = governance.active_manifest(verified)
    assert [tuple(r) for r in manifest.collect()] == [("R2", "1", "h3", "a3")]
    assert [tuple(r) for r in findings.collect()] == [("R1", "SEVERAL_ACTIVE_VERSIONS", "1,2")]
    after, conflicts = governance.promote(texts(spark, [("R1", "1", "one")]), texts(spark, [("R1", "1", "changed"), ("R2", "1", "two")]))
    assert {tuple(r) for r in after.collect()} == {("R1", "1", "one"), ("R2", "1", "two")} and [tuple(r) for r in conflicts.collect()] == [("R1", "1")]


def test_governed_rules_of_a_context(spark):
    manifest = spark.createDataFrame([("R1", "1", sha("one"), "a"), ("R2", "1", sha("two"), "b")], "rule_id string, version string, approved_hash string, approval string")
    rules = spark.createDataFrame([("R1", "north"), ("R2", None), ("R3", None)], "rule_id string, region string")
    contexts = spark.createDataFrame([("c1", "north"), ("c2", "south")], "context string, region string")
    got = {(r["context"], r["rule_id"]): r["code"] for r in governance.load_governed(manifest, texts(spark, [("R1", "1", "one"), ("R2", "1", "changed")]), rules, contexts, ["region"]).collect()}
    assert got == {("c1", "R1"): None, ("c2", "R1"): "REGION_MISMATCH", ("c1", "R2"): "HASH_MISMATCH", ("c2", "R2"): "HASH_MISMATCH", ("c1", "R3"): "NOT_ACTIVE", ("c2", "R3"): "NOT_ACTIVE"}


def derived(spark):
    t = spark.createDataFrame
    runs = t([(k,) for k in ("ready", "part", "input", "gate", "none")], "run string")
    issues = t([("ready", "i", "RESOLVED"), ("ready", "j", "CONDITIONAL"), ("part", "i", "RESOLVED"), ("part", "j", "OPEN"), ("input", "i", "RESOLVED"), ("gate", "i", "RESOLVED"), ("none", "i", "OPEN")], "run string, issue string, status string")
    gates = t([("gate", "g2", False), ("gate", "g1", None), ("ready", "g1", True)], "run string, gate string, passed boolean")
    item = "run string, item string"
    return packets.derive_packets(runs, issues, gates, t([("input", "b"), ("input", "a")], item), t([], item), t([("ready", 0.9)], "run string, score double"))


def test_packets_are_derived_and_verified(spark):
    made = derived(spark)
    rows = {r["run"]: r for r in made.collect()}
    assert {k: r["status"] for k, r in rows.items()} == {"ready": "READY_FOR_REVIEW", "part": "PARTIAL", "input": "NEEDS_INPUT", "gate": "ABSTAINED", "none": "ABSTAINED"}
    assert json.loads(rows["gate"]["packet"])["failed_gates"] == ["g1", "g2"] and json.loads(rows["input"]["packet"])["missing_inputs"] == ["a", "b"]
    other = rows["part"]["packet"].replace("PARTIAL", "READY_FOR_REVIEW")
    stored = spark.createDataFrame([("ready", rows["ready"]["packet"], rows["ready"]["packet_hash"]), ("part", other, sha(other)), ("input", rows["input"]["packet"], "x"), ("zzz", "{}", sha("{}"))], "run string, packet string, packet_hash string")
    assert {tuple(r) for r in packets.verify_packets(made, stored).collect()} == {("part", "PACKET_DIFFERS"), ("input", "PACKET_HASH_MISMATCH"), ("gate", "PACKET_MISSING"), ("none", "PACKET_MISSING"), ("zzz", "UNKNOWN_RUN")}


def test_release_needs_packet_artifacts_and_decision(spark):
    made = derived(spark)
    rows = {r["run"]: r for r in made.collect()}
    stored = made.select("run", "packet", "packet_hash")
    file = "run string, path string, sha256 string"
    said, files = spark.createDataFrame([("ready", "a", "1"), ("ready", "b", "2"), ("ready", "c", "3")], file), spark.createDataFrame([("ready", "a", "1"), ("ready", "b", "9"), ("ready", "d", "4")], file)
    artifacts = packets.verify_artifacts(spark.createDataFrame([("ready", "a"), ("ready", "c"), ("ready", "e")], "run string, path string"), said, files)
    assert {tuple(r)[1:] for r in artifacts.collect()} == {("b", "HASH_MISMATCH"), ("c", "REQUIRED_MISSING"), ("e", "REQUIRED_MISSING"), ("d", "UNDECLARED")}
    decision = "run string, at int, packet_hash string, decision string"
    good = spark.createDataFrame([("ready", 1, "old", "REJECTED"), ("ready", 2, rows["ready"]["packet_hash"], "APPROVED")], decision)
    none = artifacts.limit(0)
    errors = lambda decisions, found: {r["code"] for r in packets.release_errors(made, stored, decisions, found).where("run = 'ready'").collect()}
    assert errors(good, none) == set()
    assert errors(good, artifacts) == {"ARTIFACT_HASH_MISMATCH", "ARTIFACT_REQUIRED_MISSING", "ARTIFACT_UNDECLARED"}
    assert errors(good.limit(0), none) == {"NOT_DECIDED"} and errors(good.where("at = 1"), none) == {"DECISION_OF_OTHER_PACKET"}
    assert {r["code"] for r in packets.release_errors(made, stored, good, none).where("run = 'part'").collect()} == {"NOT_READY"}


def test_runs_compared_and_shown(spark):
    t = spark.createDataFrame
    file = "pair string, path string, sha256 string"
    left = t([("a", "x", "1"), ("b", "x", "1"), ("c", "x", "1"), ("d", "x", "1")], file)
    right = t([("a", "x", "1"), ("b", "x", "2"), ("c", "x", "2"), ("d", "x", "1")], file)
    runs = t([("a", "e", "e"), ("b", "e", "e"), ("c", "e", "e"), ("d", "e", "f")], "pair string, left_environment string, right_environment string")
    assert dict(packets.compare_parser_runs(runs, t([("c", "CHANGED")], "pair string, kind string"), left, right).collect()) == {"a": "BYTE_IDENTICAL", "b": "EQUIVALENT", "c": "DIFFERENT", "d": "ENVIRONMENT_MISMATCH"}
    assert dict(packets.byte_equal(left.where("pair = 'b'").drop("pair"), right.where("pair = 'b'").drop("pair")).collect()) == {"x": False}
    views = packets.review_views(derived(spark), t([("ready", "c1", "text"), ("ready", "c2", "more")], "run string, claim string, text string"), t([("ready", "c1", "e1"), ("ready", "c1", "e9")], "run string, claim string, evidence string"), t([("e1", "d", 3, "quote")], "evidence string, document string, page int, text string"))
    view = views.where("run = 'ready'").first()
    assert [(c["claim"], [(x["evidence"], x["resolved"]) for x in c["citations"]]) for c in view["claims"]] == [("c1", [("e1", True), ("e9", False)]), ("c2", [])]
