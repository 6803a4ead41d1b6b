"""Drawings of a case: confirmed calibrations, lengths by them, quality of sources against a policy, and the state of the case."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridock.functions.canonical import canonical_json, content_id
from veridock.functions.numbers import decimal_text

#: Exact arithmetic of lengths and scales.
LENGTH, SCALE = "decimal(18,6)", "decimal(38,18)"
#: Reasons by parser outcome, MIME types of images, reasons by trust in a physical size.
PARSER_REASON = {"TIMEOUT": "PARSER_TIMEOUT", "MEMORY_LIMIT": "PARSER_MEMORY_LIMIT", "INVALID_OUTPUT": "PARSER_OUTPUT_INVALID", "UNAVAILABLE": "PARSER_UNAVAILABLE"}
IMAGES = ("image/png", "image/tiff", "image/jpeg")
TRUST_REASON = {"METADATA_ONLY": "METADATA_ONLY_PHYSICAL_SIZE", "UNKNOWN": "UNKNOWN_PHYSICAL_SIZE"}


@dataclass(frozen=True)
class Policy:
    """Limits of an intake."""

    max_file_bytes: int = 100 * 1024 * 1024
    max_pdf_pages: int = 200
    max_image_pixels: int = 100_000_000
    max_case_image_pixels: int = 400_000_000


def pixel_length(axis: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of two points along their axis; null if they don't lie on one line of it, or agree."""
    dx, dy = (F.abs(b.cast(LENGTH) - a.cast(LENGTH)) for a, b in ((x1, x2), (y1, y2)))
    return F.when((axis == "x") & (dy == 0) & (dx > 0), dx).when((axis == "y") & (dx == 0) & (dy > 0), dy)


def reference_errors(references: DataFrame) -> DataFrame:
    """source, page, code of calibration references (source, page, axis, x1, y1, x2, y2, real, unit, reviewer) that can't be used, one row per code."""
    length = pixel_length(F.col("axis"), *[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    real = F.col("real").try_cast(LENGTH)
    reviewer = F.coalesce("reviewer", F.lit(""))
    checks = [
        (F.col("page") < 1, "PAGE_NOT_POSITIVE"), (~F.coalesce(F.col("axis").isin("x", "y"), F.lit(False)), "UNKNOWN_AXIS"), (length.isNull(), "NOT_ON_AXIS"), (real.isNull() | (real <= 0), "LENGTH_NOT_POSITIVE"),
        (F.coalesce(F.trim("unit"), F.lit("")) == "", "UNIT_MISSING"), ((reviewer == "") | (reviewer != F.trim(reviewer)) | (F.length(reviewer) > 128) | reviewer.rlike(r"[/\\\x00-\x1f\x7f]"), "REVIEWER_INVALID"),
    ]
    single = references.select("source", "page", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(True)), c) for t, c in checks]))).alias("code"))
    groups = references.groupBy("source", "page").agg((F.count(F.lit(1)) > F.count_distinct("axis")).alias("twice"), (F.count_distinct("unit") > 1).alias("units"))
    both = [groups.where(flag).select("source", "page", F.lit(code).alias("code")) for flag, code in (("twice", "AXIS_TWICE"), ("units", "UNITS_DIFFER"))]
    return reduce(DataFrame.unionByName, [single, *both]).distinct()


def calibrations(references: DataFrame) -> DataFrame:
    """source, page, id, scale_x, scale_y (real length a pixel, exact decimals as text), unit, reviewer of pages all of whose references hold.

    An axis without a reference has no scale: nothing is inferred from the other.
    """
    sound = references.join(reference_errors(references).select("source", "page").distinct(), ["source", "page"], "left_anti")
    length = pixel_length(F.col("axis"), *[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    scale = F.col("real").cast(LENGTH).cast(SCALE) / length.cast(SCALE)
    rows = sound.withColumn("scale", decimal_text(scale.cast("decimal(38,12)")))
    made = rows.groupBy("source", "page").agg(F.max(F.when(F.col("axis") == "x", F.col("scale"))).alias("scale_x"), F.max(F.when(F.col("axis") == "y", F.col("scale"))).alias("scale_y"), F.max("unit").alias("unit"), F.max("reviewer").alias("reviewer"))
    payload = canonical_json(source=F.col("source").cast("string"), page=F.col("page"), scale_x=F.col("scale_x"), scale_y=F.col("scale_y"), unit=F.col("unit"), reviewer=F.col("reviewer"))
    return made.select("source", "page", content_id("CAL-", payload).alias("id"), "scale_x", "scale_y", "unit", "reviewer")


def real_lengths(measured: DataFrame, calibrated: DataFrame) -> DataFrame:
    """Measured rows (source, page, axis, pixels and more) with ``real`` as decimal text, ``unit`` and ``code``: NOT_CALIBRATED where the axis has no confirmed scale, INVALID_LENGTH for no positive number."""
    scales = calibrated.select("source", "page", "scale_x", "scale_y", "unit")
    joined = measured.join(scales, ["source", "page"], "left")
    scale = F.when(F.col("axis") == "x", F.col("scale_x")).when(F.col("axis") == "y", F.col("scale_y")).cast("decimal(20,12)")
    pixels = F.col("pixels").cast("string").try_cast(LENGTH)
    code = F.when(pixels.isNull() | (pixels <= 0), "INVALID_LENGTH").when(scale.isNull(), "NOT_CALIBRATED")
    real = F.when(code.isNull(), decimal_text((pixels * scale).cast("decimal(38,12)")))
    return joined.select(*measured.columns, real.alias("real"), "unit", code.alias("code"))


def assess(sources: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """case, source, quality, reasons, pixels of sources (case, source, ord, sha256, seen_sha256, byte_size, mime, outcome, pages, width, height, lossy, trust).

    Nothing of an image is opened: its size is what an isolated parser said. Pixels of
    a case's images add up in order. A source whose bytes aren't those the parser saw
    is refused for that alone, one that the parser couldn't read is looked at by a
    human unless it is too large.
    """
    image = F.col("mime").isin(*IMAGES)
    whole = F.coalesce(F.col("sha256") == F.col("seen_sha256"), F.lit(False))
    parsed = F.coalesce(F.col("outcome") == "SUCCESS", F.lit(False))
    pixels = F.when(whole & parsed & image, F.col("width").cast("long") * F.col("height"))
    # A case is a file's worth of drawings.
    before = Window.partitionBy("case").orderBy("ord", "source").rowsBetween(Window.unboundedPreceding, 0)
    rows = sources.withColumn("pixels", pixels).withColumn("total", F.sum("pixels").over(before))
    failed = F.create_map(*[F.lit(x) for pair in PARSER_REASON.items() for x in pair])[F.col("outcome")]
    trust = F.create_map(*[F.lit(x) for pair in TRUST_REASON.items() for x in pair])[F.col("trust")]
    too_large = F.col("byte_size") > policy.max_file_bytes
    pdf = F.col("mime") == "application/pdf"
    hard = [
        (too_large, "FILE_SIZE_LIMIT_EXCEEDED"), (parsed & pdf & (F.col("pages") > policy.max_pdf_pages), "PDF_PAGE_LIMIT_EXCEEDED"), (F.col("pixels") > policy.max_image_pixels, "IMAGE_PIXEL_LIMIT_EXCEEDED"),
        (F.col("pixels").isNotNull() & (F.col("total") > policy.max_case_image_pixels), "CASE_PIXEL_LIMIT_EXCEEDED"), (parsed & ~F.coalesce(image | pdf, F.lit(False)), "UNSUPPORTED_MIME"),
    ]
    soft = [
        (~parsed, F.coalesce(failed, F.lit("PARSER_UNAVAILABLE"))), (parsed & pdf & F.col("pages").isNull(), F.lit("PDF_PAGE_COUNT_UNKNOWN")), (parsed & image & F.col("pixels").isNull(), F.lit("IMAGE_DIMENSIONS_UNKNOWN")),
        (parsed & F.col("lossy"), F.lit("LOSSY_OR_SCREEN_CAPTURE_SOURCE")), (parsed & trust.isNotNull(), trust),
    ]
    flags = lambda checks: F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(c) if isinstance(c, str) else c) for t, c in checks]))
    judged = rows.withColumn("hard", flags(hard)).withColumn("soft", flags(soft))
    quality = F.when(~whole | (F.size("hard") > 0), "REJECTED").when(F.size("soft") > 0, "REVIEW_REQUIRED").otherwise("PASS")
    reasons = F.when(~whole, F.array(F.lit("SOURCE_HASH_MISMATCH"))).otherwise(F.concat("hard", "soft"))
    return judged.select("case", "source", quality.alias("quality"), reasons.alias("reasons"), "pixels")


def workflow_state(has_source: Column, broken: Column, rejected: Column, conflict: Column, missing: Column, validated: Column) -> Column:
    """Struct state, reason, resumable of a case's drawings; flags that are null count as false."""
    f = lambda c: F.coalesce(c, F.lit(False))
    row = lambda state, reason, again: F.struct(F.lit(state).alias("state"), F.lit(reason).cast("string").alias("reason"), F.lit(again).alias("resumable"))
    confirm = row("INPUT_CONFIRMATION_REQUIRED", None, False)
    return (
        F.when(f(broken), row("FAILED", "SOURCE_HASH_MISMATCH", False)).when(f(rejected), row("BLOCKED", "DRAWING_QUALITY_REJECTED", True)).when(~f(has_source), row("PENDING_DRAWING_INGESTION", None, False))
        .when(f(conflict) | f(missing), confirm).when(f(validated), row("READY_TO_EVALUATE", None, False)).otherwise(confirm)
    )


def case_states(cases: DataFrame, assessed: DataFrame, inputs: DataFrame) -> DataFrame:
    """case, state, reason, resumable of cases (case), their sources as of ``assess`` and their confirmed inputs (case, conflict, missing, validated)."""
    sources = assessed.groupBy("case").agg(F.lit(True).alias("has"), F.bool_or(F.array_contains("reasons", "SOURCE_HASH_MISMATCH")).alias("broken"), F.bool_or(F.col("quality") == "REJECTED").alias("rejected"))
    said = inputs.groupBy("case").agg(F.bool_or("conflict").alias("conflict"), F.bool_or("missing").alias("missing"), F.bool_and("validated").alias("validated"))
    joined = cases.select("case").distinct().join(sources, "case", "left").join(said, "case", "left")
    made = workflow_state(*[F.col(c) for c in ("has", "broken", "rejected", "conflict", "missing", "validated")])
    return joined.select("case", made.alias("s")).select("case", "s.state", "s.reason", "s.resumable")
