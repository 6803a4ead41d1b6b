"""Calibrations, lengths, quality and states of drawings on small tables."""

from veridock.operators import drawings
from veridock.operators.drawings import Policy

REF = "source string, page int, axis string, x1 string, y1 string, x2 string, y2 string, real string, unit string, reviewer string"
SRC = "case string, source string, ord int, sha256 string, seen_sha256 string, byte_size long, mime string, outcome string, pages int, width int, height int, lossy boolean, trust string"


def ref(source="s", page=1, axis="x", x1="0", y1="5", x2="40", y2="5", real="10", unit="m", reviewer="ann"):
    return (source, page, axis, x1, y1, x2, y2, real, unit, reviewer)


def test_calibrations_are_exact_and_by_axis(spark):
    rows = [ref(), ref(axis="y", x1="7", x2="7", y1="1.5", y2="31.5", real="7.5"), ref("third", x2="3", real="1"), ref("one", page=2)]
    got = {(r["source"], r["page"]): r for r in drawings.calibrations(spark.createDataFrame(rows, REF)).collect()}
    assert (got[("s", 1)]["scale_x"], got[("s", 1)]["scale_y"], got[("s", 1)]["unit"]) == ("0.25", "0.25", "m")
    assert got[("third", 1)]["scale_x"] .startswith("0.333333") and got[("one", 2)]["scale_y"] is None
    assert len({r["id"] for r in got.values()}) == 3


def test_references_that_cannot_be_used(spark):
    rows = [
        ref("slant", y2="6"), ref("point", x2="0"), ref("axis", axis="z"), ref("zero", real="0"), ref("text", real="ten"), ref("unit", unit=" "), ref("who", reviewer=" ann"), ref("path", reviewer="a/b"), ref("page", page=0),
        ref("twice"), ref("twice", real="11"), ref("units"), ref("units", axis="y", x1="7", x2="7", y1="0", y2="9", unit="ft"), ref("good"),
    ]
    df = spark.createDataFrame(rows, REF)
    got = {}
    for r in drawings.reference_errors(df).collect():
        got.setdefault(r["source"], set()).add(r["code"])
    assert got == {
        "slant": {"NOT_ON_AXIS"}, "point": {"NOT_ON_AXIS"}, "axis": {"UNKNOWN_AXIS", "NOT_ON_AXIS"}, "zero": {"LENGTH_NOT_POSITIVE"}, "text": {"LENGTH_NOT_POSITIVE"}, "unit": {"UNIT_MISSING"}, "who": {"REVIEWER_INVALID"}, "path": {"REVIEWER_INVALID"},
        "page": {"PAGE_NOT_POSITIVE"}, "twice": {"AXIS_TWICE"}, "units": {"UNITS_DIFFER"},
    }
    assert [r["source"] for r in drawings.calibrations(df).collect()] == ["good"]


def test_lengths_only_by_confirmed_scales(spark):
    calibrated = drawings.calibrations(spark.createDataFrame([ref()], REF))
    rows = [("s", 1, "x", "12.5"), ("s", 1, "y", "12.5"), ("s", 2, "x", "1"), ("s", 1, "x", "-1"), ("s", 1, "x", "wide")]
    got = [(r["real"], r["code"]) for r in drawings.real_lengths(spark.createDataFrame(rows, "source string, page int, axis string, pixels string").coalesce(1), calibrated).orderBy("page", "axis", "pixels").collect()]
    assert sorted(got, key=str) == sorted([("3.125", None), (None, "NOT_CALIBRATED"), (None, "NOT_CALIBRATED"), (None, "INVALID_LENGTH"), (None, "INVALID_LENGTH")], key=str)


def src(case, source, n=0, sha="h", seen="h", size=10, mime="image/png", outcome="SUCCESS", pages=None, width=10, height=10, lossy=False, trust="USER_CONFIRMED"):
    return (case, source, n, sha, seen, size, mime, outcome, pages, width, height, lossy, trust)


def test_quality_and_state_of_cases(spark):
    rows = [
        src("ok", "a"), src("hash", "a", seen="x", size=999), src("big", "a", size=999), src("slow", "a", outcome="TIMEOUT"), src("slowbig", "a", outcome="TIMEOUT", size=999), src("pdf", "a", mime="application/pdf", pages=3), src("pages", "a", mime="application/pdf", pages=99),
        src("nopages", "a", mime="application/pdf"), src("nosize", "a", width=None), src("pixels", "a", width=1000), src("sum", "a", 1, width=60), src("sum", "b", 2, width=60), src("mime", "a", mime="text/plain"), src("soft", "a", lossy=True, trust="METADATA_ONLY"),
    ]
    policy = Policy(max_file_bytes=100, max_pdf_pages=10, max_image_pixels=5_000, max_case_image_pixels=1_000)
    assessed = drawings.assess(spark.createDataFrame(rows, SRC), policy)
    got = {(r["case"], r["source"]): (r["quality"], r["reasons"]) for r in assessed.collect()}
    assert got == {
        ("ok", "a"): ("PASS", []), ("hash", "a"): ("REJECTED", ["SOURCE_HASH_MISMATCH"]), ("big", "a"): ("REJECTED", ["FILE_SIZE_LIMIT_EXCEEDED"]), ("slow", "a"): ("REVIEW_REQUIRED", ["PARSER_TIMEOUT"]),
        ("slowbig", "a"): ("REJECTED", ["FILE_SIZE_LIMIT_EXCEEDED", "PARSER_TIMEOUT"]), ("pdf", "a"): ("PASS", []), ("pages", "a"): ("REJECTED", ["PDF_PAGE_LIMIT_EXCEEDED"]), ("nopages", "a"): ("REVIEW_REQUIRED", ["PDF_PAGE_COUNT_UNKNOWN"]),
        ("nosize", "a"): ("REVIEW_REQUIRED", ["IMAGE_DIMENSIONS_UNKNOWN"]), ("pixels", "a"): ("REJECTED", ["IMAGE_PIXEL_LIMIT_EXCEEDED", "CASE_PIXEL_LIMIT_EXCEEDED"]), ("sum", "a"): ("PASS", []), ("sum", "b"): ("REJECTED", ["CASE_PIXEL_LIMIT_EXCEEDED"]),
        ("mime", "a"): ("REJECTED", ["UNSUPPORTED_MIME"]), ("soft", "a"): ("REVIEW_REQUIRED", ["LOSSY_OR_SCREEN_CAPTURE_SOURCE", "METADATA_ONLY_PHYSICAL_SIZE"]),
    }
    cases = spark.createDataFrame([(c,) for c in ("ok", "hash", "big", "pdf", "soft", "none", "slow")], "case string")
    inputs = spark.createDataFrame([("ok", False, False, True), ("pdf", True, False, True), ("soft", False, True, True)], "case string, conflict boolean, missing boolean, validated boolean")
    states = {r["case"]: (r["state"], r["resumable"]) for r in drawings.case_states(cases, assessed, inputs).collect()}
    assert states == {
        "ok": ("READY_TO_EVALUATE", False), "hash": ("FAILED", False), "big": ("BLOCKED", True), "pdf": ("INPUT_CONFIRMATION_REQUIRED", False), "soft": ("INPUT_CONFIRMATION_REQUIRED", False), "none": ("PENDING_DRAWING_INGESTION", False),
        "slow": ("INPUT_CONFIRMATION_REQUIRED", False),
    }
