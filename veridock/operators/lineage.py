"""Lineage: fingerprint matches, id maps, citations, differences, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridock.functions.geometry import boxes_agree
from veridock.operators.ranks import group_ranks


def match_fingerprints(left: DataFrame, right: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """left_id, right_id, code: equal fingerprints are paired in order of id, each row once; rows left over are MISSING.

    ``left`` rows whose fingerprint has more rows on the right than on the left are AMBIGUOUS as well as paired.
    """
    a = group_ranks(left.select(F.col(key).alias("left_id"), fingerprint), [fingerprint], ["left_id"], "nth", "n_left")
    b = group_ranks(right.select(F.col(key).alias("right_id"), fingerprint), [fingerprint], ["right_id"], "nth", "n_right")
    joined = a.join(b, [fingerprint, "nth"], "left")
    code = F.when(F.col("right_id").isNull(), "MISSING").when(F.col("n_right") > F.col("n_left"), "AMBIGUOUS").otherwise("MATCHED")
    return joined.select("left_id", "right_id", code.alias("code"))


def remap_links(links: DataFrame, id_map: DataFrame) -> DataFrame:
    """source, target, relation with both ends replaced by the map(old, new) where it has them."""
    s, t = id_map.select(F.col("old").alias("source"), F.col("new").alias("s")), id_map.select(F.col("old").alias("target"), F.col("new").alias("t"))
    return links.join(s, "source", "left").join(t, "target", "left").select(F.coalesce("s", "source").alias("source"), F.coalesce("t", "target").alias("target"), "relation")


def resolve_citations(citations: DataFrame, evidence: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """citation_id, codes: what a citation's identity disagrees on; empty if it resolves."""
    e = evidence.select("evidence_id", *[F.col(c).alias(f"e_{c}") for c in ("document_id", "revision_id", "page_number", "bbox", "source_hash")])
    joined = citations.join(e, "evidence_id", "left")
    missing = F.col("e_document_id").isNull()

    def differs(c: str) -> Column:
        return ~missing & ~F.col(c).eqNullSafe(F.col(f"e_{c}"))

    codes = F.filter(
        F.array(
            F.when(missing, F.lit("EVIDENCE_NOT_FOUND")), F.when(differs("document_id"), F.lit("DOCUMENT_MISMATCH")), F.when(differs("revision_id"), F.lit("REVISION_MISMATCH")),
            F.when(differs("page_number"), F.lit("PAGE_MISMATCH")), F.when(~missing & ~boxes_agree(F.col("bbox"), F.col("e_bbox"), tolerance), F.lit("BBOX_MISMATCH")),
            F.when(differs("source_hash"), F.lit("SOURCE_HASH_MISMATCH")),
        ),
        lambda x: x.isNotNull(),
    )
    return joined.select("citation_id", codes.alias("codes"))


def validate_claims(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """claim_id, code: UNCITED, UNRESOLVED or CROSS_ISSUE per offending claim.

    claims(claim_id, issue_ids, citation_ids), citations(citation_id, issue_ids, resolved).
    """
    uncited = claims.where(F.size("citation_ids") == 0).select("claim_id", F.lit("UNCITED").alias("code"))
    flat = claims.select("claim_id", "issue_ids", F.explode("citation_ids").alias("citation_id"))
    joined = flat.join(citations.select("citation_id", F.col("issue_ids").alias("c_issues"), "resolved"), "citation_id", "left")
    bad = F.when(~F.coalesce("resolved", F.lit(False)), "UNRESOLVED").when(~F.arrays_overlap("issue_ids", "c_issues"), "CROSS_ISSUE")
    return uncited.union(joined.select("claim_id", bad.alias("code")).where("code IS NOT NULL").distinct())


def structural_diff(left: DataFrame, right: DataFrame, key: list[str], value: str) -> DataFrame:
    """key columns, kind: ADDED, REMOVED or CHANGED between two keyed sets."""
    a, b = left.select(*key, F.col(value).alias("__a"), F.lit(True).alias("__in_a")), right.select(*key, F.col(value).alias("__b"), F.lit(True).alias("__in_b"))
    kind = F.when(F.col("__in_b").isNull(), "REMOVED").when(F.col("__in_a").isNull(), "ADDED").when(~F.col("__a").eqNullSafe(F.col("__b")), "CHANGED")
    return a.join(b, key, "full").select(*key, kind.alias("kind"), F.col("__a").alias("left_value"), F.col("__b").alias("right_value")).where("kind IS NOT NULL")


def warning_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id, kind of warnings(id, code, message): those only on one side are paired by (code, message) in order of id."""
    gone, new = left.join(right, "id", "left_anti"), right.join(left, "id", "left_anti")
    a, b = (group_ranks(side.select(F.col("id").alias(name), "code", "message"), ["code", "message"], [name], "n") for side, name in ((gone, "left_id"), (new, "right_id")))
    kind = F.when(F.col("right_id").isNull(), "WARNING_REMOVED").when(F.col("left_id").isNull(), "WARNING_ADDED").otherwise("WARNING_CHANGED")
    return a.join(b, ["code", "message", "n"], "full").select("left_id", "right_id", kind.alias("kind"))


def upsert(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """key, first_seen, last_seen, sightings: earliest and latest sighting, and their number."""
    both = previous.select(key, "first_seen", "last_seen", "sightings").unionByName(current.select(key, F.col("seen").alias("first_seen"), F.col("seen").alias("last_seen"), F.lit(1).cast("long").alias("sightings")))
    return both.groupBy(key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("sightings").alias("sightings"))


def keep_reviewed(old: DataFrame, new: DataFrame) -> DataFrame:
    """stable_id, text, review_status, unresolved: reviewed text survives where the source is the same, else it is AUTOMATIC and listed."""
    o = old.select("stable_id", F.col("source_hash").alias("o_hash"), F.col("text").alias("o_text"), F.col("review_status").alias("o_status"))
    same = F.col("source_hash").eqNullSafe(F.col("o_hash"))
    reviewed = F.coalesce(F.col("o_status") != "AUTOMATIC", F.lit(False))
    return new.join(o, "stable_id", "left").select(
        "stable_id",
        F.when(same & reviewed, F.col("o_text")).otherwise(F.col("text")).alias("text"),
        F.when(same & reviewed, F.col("o_status")).otherwise("AUTOMATIC").alias("review_status"),
        (reviewed & ~same).alias("unresolved"),
    )


def set_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """only_left, only_right: rows of one side beyond the other; both 0 if the bags are equal."""
    left, right = a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_left")), b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_right"))
    return left.crossJoin(right)


def json_entries(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, value of the top-level fields of a flat JSON object; ``json_paths`` takes nested ones."""
    return df.select(key, F.explode(F.from_json(text, "map<string,string>")).alias("path", "value"))


def json_paths(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, type, value: the leaves of JSON texts of any shape, with typed paths.

    A field adds ``.name`` (``["name"]`` where the name isn't plain), an element of an array
    ``[place]``; empty objects and arrays are leaves. Objects are opened level by
    level, by rows and without a shuffle, as deep as the deepest text. A text that is
    no JSON is one leaf of type INVALID, null texts have none.
    """
    spark = df.sparkSession
    parsed = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.lit("$").alias("path"), F.try_parse_json(text).alias("v"), F.col(text).alias("raw"))
    invalid = parsed.where("v IS NULL").select("k", "path", F.lit("INVALID").alias("type"), F.col("raw").alias("value"))
    level = parsed.where("v IS NOT NULL").select("k", "path", "v", F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("value"))
    while True:
        # Leaves go along as they are, so each text is parsed in one pass and not again for every level.
        typed = level.withColumn("kind", F.when(F.col("type").isNull(), F.schema_of_variant("v"))).withColumn("json", F.when(F.col("type").isNull(), F.to_json("v")))
        nested = F.coalesce(F.col("kind").rlike("^(OBJECT|ARRAY)<") & ~F.col("json").isin("{}", "[]"), F.lit(False))
        plain = F.when(F.col("kind").startswith("OBJECT<"), "OBJECT").when(F.col("kind").startswith("ARRAY<"), "ARRAY").otherwise(F.regexp_replace("kind", r"\(.*", ""))
        typed = typed.withColumn("nested", nested)
        typed = typed.select("k", "path", F.when(F.col("nested"), F.col("v")).alias("v"), F.when(~F.col("nested"), F.coalesce("type", plain)).alias("type"), F.when(~F.col("nested"), F.coalesce("value", "json")).alias("value"))
        if typed.where("type IS NULL").isEmpty():
            break
        name = F.when(F.col("e_key").isNull(), F.concat(F.lit("["), F.col("e_pos").cast("string"), F.lit("]"))).when(F.col("e_key").rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.concat(F.lit("."), "e_key"))
        name = name.otherwise(F.to_json(F.array("e_key")))
        opened = typed.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()).toDF("e_pos", "e_key", "e_value"))
        level = opened.select("k", F.when(F.col("type").isNull(), F.concat("path", name)).otherwise(F.col("path")).alias("path"), F.col("e_value").alias("v"), "type", "value")
    return typed.select("k", "path", "type", "value").unionByName(invalid).withColumnRenamed("k", key)


def json_differences(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, kind, left_value, right_value of two tables of JSON texts: leaves ADDED, REMOVED, CHANGED, or TYPE_CHANGED."""
    a = json_paths(left, key, text).select(key, "path", F.col("type").alias("lt"), F.col("value").alias("left_value"))
    b = json_paths(right, key, text).select(key, "path", F.col("type").alias("rt"), F.col("value").alias("right_value"))
    kind = F.when(F.col("rt").isNull(), "REMOVED").when(F.col("lt").isNull(), "ADDED").when(F.col("lt") != F.col("rt"), "TYPE_CHANGED").when(F.col("left_value") != F.col("right_value"), "CHANGED")
    return a.join(b, [key, "path"], "full").select(key, "path", kind.alias("kind"), "left_value", "right_value").where("kind IS NOT NULL")
