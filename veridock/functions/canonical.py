"""Canonical JSON, content ids and order-free digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(**fields: Column) -> Column:
    """JSON object with keys in order and no spaces; a null field is written as null, so two payloads that differ in one differ."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def sorted_map_json(col: Column) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(col))))


def content_id(prefix: str, payload: Column, digits: int = 20) -> Column:
    """Prefix and the first digits of the payload's SHA-256, in upper case."""
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(payload, 256), 1, digits)))


def row_text(df: DataFrame, *columns: str) -> Column:
    """Fields of a row as text, null marked, between unit separators."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in (columns or df.columns)])


def table_digest(df: DataFrame, text: Column) -> DataFrame:
    """n_rows and a digest of the bag of rows: sums of two parts of each row's SHA-256, merged map-side."""
    h = F.sha2(text, 256)
    return df.select(h.alias("h")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(20,0)")).cast("string").alias("digest_a"),
        F.sum(F.conv(F.substring("h", 13, 12), 16, 10).cast("decimal(20,0)")).cast("string").alias("digest_b"),
    )
