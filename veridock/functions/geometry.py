"""Boxes in page space: normalisation, projection, checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """Box struct with its sides in order."""
    return F.struct(F.least(left, right).alias("left"), F.least(bottom, top).alias("bottom"), F.greatest(left, right).alias("right"), F.greatest(bottom, top).alias("top"))


def normalize_box(b: Column, width: Column, height: Column, rotation: Column) -> Column:
    """Displayed box (origin top left) to page space (origin bottom left) of a page turned clockwise by ``rotation``."""
    l, t, r, d = b["left"], b["bottom"], b["right"], b["top"]
    return (
        F.when(rotation == 90, box(t, l, d, r))
        .when(rotation == 180, box(width - r, t, width - l, d))
        .when(rotation == 270, box(width - d, height - r, width - t, height - l))
        .otherwise(box(l, height - d, r, height - t))
    )


def project_box(b: Column, width: Column, height: Column, rotation: Column) -> Column:
    """The inverse of normalize_box."""
    l, o, r, t = b["left"], b["bottom"], b["right"], b["top"]
    return (
        F.when(rotation == 90, box(o, l, t, r))
        .when(rotation == 180, box(width - r, o, width - l, t))
        .when(rotation == 270, box(height - t, width - r, height - o, width - l))
        .otherwise(box(l, height - t, r, height - o))
    )


def clamp_box(b: Column, width: Column, height: Column, tolerance: float) -> Column:
    """Box cut to the page; null if it leaves the page by more than ``tolerance`` or is inverted."""
    inside = (b["left"] >= -tolerance) & (b["bottom"] >= -tolerance) & (b["right"] <= width + tolerance) & (b["top"] <= height + tolerance)
    cut = F.struct(
        F.greatest(b["left"], F.lit(0.0)).alias("left"), F.greatest(b["bottom"], F.lit(0.0)).alias("bottom"),
        F.least(b["right"], width).alias("right"), F.least(b["top"], height).alias("top"),
    )
    return F.when(inside & (b["left"] <= b["right"]) & (b["bottom"] <= b["top"]), cut)


def boxes_agree(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """All four sides within ``tolerance``; two missing boxes agree."""
    sides = [F.abs(a[s] - b[s]) <= tolerance for s in ("left", "bottom", "right", "top")]
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(sides[0] & sides[1] & sides[2] & sides[3])


def path_bounds(points: Column) -> Column:
    """Box around an array of [x, y] points."""
    x, y = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(x).alias("left"), F.array_min(y).alias("bottom"), F.array_max(x).alias("right"), F.array_max(y).alias("top"))
