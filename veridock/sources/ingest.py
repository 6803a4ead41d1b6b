"""Ingest of evidence: pages resolved, boxes clamped, references checked over all entities, and publication with a manifest that proves what was written."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridock.functions.canonical import table_digest
from veridock.sources.evidence import SCHEMAS, read_evidence

#: Which entity an entity's column leads to, and entities whose rows stand on a page.
PARENTS = (("revisions", "document_id", "documents"), ("pages", "revision_id", "revisions"), ("elements", "page_id", "pages"), ("clauses", "revision_id", "revisions"), ("tables", "page_id", "pages"), ("visuals", "page_id", "pages"))
ON_PAGES = ("elements", "tables", "visuals")
#: Entities that links and review flags may lead to.
CITABLE = ("documents", "revisions", "pages", "elements", "clauses", "tables", "visuals")
#: Rows that lead to one end are dealt into so many parts.
PARTS = 64
MANIFEST = "entity string, n_rows long, digest_a string, digest_b string"


class IngestError(ValueError):
    """Rows that may not be published."""


def resolve_pages(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows with page_id filled in and code: by the page's id, else by revision_id and page_number.

    A row may name its page twice; PAGE_REFERENCE_MISMATCH says that the two disagree,
    PAGE_REFERENCE_NOT_FOUND that there is no such page. Rows go through one join by id
    and one by place, each only for the rows that need it.
    """
    names = rows.columns
    declared = [F.col(c) if c in names else F.lit(None).cast(t).alias(c) for c, t in (("revision_id", "string"), ("page_number", "int"))]
    given = rows.select(*[c for c in names if c not in ("revision_id", "page_number")], *declared)
    place = pages.select(F.col("id").alias("__page"), F.col("revision_id").alias("__revision"), F.col("page_number").alias("__number"))
    by_id = given.where("page_id IS NOT NULL").join(place, F.col("page_id") == F.col("__page"), "left")
    by_place = given.where("page_id IS NULL").join(place, (F.col("revision_id") == F.col("__revision")) & (F.col("page_number") == F.col("__number")), "left")
    both = by_id.unionByName(by_place)
    other = (F.col("revision_id") != F.col("__revision")) | (F.col("page_number") != F.col("__number"))
    code = F.when(F.col("__page").isNull(), "PAGE_REFERENCE_NOT_FOUND").when(F.coalesce(other, F.lit(False)), "PAGE_REFERENCE_MISMATCH")
    return both.withColumn("page_id", F.coalesce("__page", "page_id")).withColumn("code", code).drop("__page", "__revision", "__number")


def clamp(box: Column, width: Column, height: Column) -> Column:
    """A box cut to its page."""
    inside = lambda c, most: F.least(F.greatest(c, F.lit(0.0)), most)
    cut = F.struct(inside(box["left"], width).alias("left"), inside(box["bottom"], height).alias("bottom"), inside(box["right"], width).alias("right"), inside(box["top"], height).alias("top"))
    return F.when(box.isNotNull(), cut)


def prepared(raw: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Entities in their schemas with pages resolved and boxes clamped, and (entity, id, code) of rows whose page isn't clear."""
    missing = set(SCHEMAS) - set(raw)
    if missing:
        raise IngestError(f"no table for {', '.join(sorted(missing))}")
    out, bad = {}, []
    sizes = raw["pages"].select(F.col("id").alias("page_id"), "width", "height")
    for name, schema in SCHEMAS.items():
        rows, columns = raw[name], T.StructType.fromDDL(schema)
        if name in ON_PAGES:
            rows = resolve_pages(rows, raw["pages"])
            bad.append(rows.where("code IS NOT NULL").select(F.lit(name).alias("entity"), "id", "code"))
            if "bbox" in rows.columns:
                rows = rows.join(sizes, "page_id", "left").withColumn("bbox", clamp(F.col("bbox"), F.col("width"), F.col("height")))
        out[name] = rows.select(*[F.col(f.name).cast(f.dataType) for f in columns])
    return out, reduce(DataFrame.unionByName, bad)


def _unknown(rows: DataFrame, entity: str, column: str, known: DataFrame, shared: bool = False) -> DataFrame:
    """Rows whose column leads to no known id, or to none.

    Where a ``shared`` end may be that of a third of the rows, only distinct ends meet
    the known ids; rows are dealt by their own id, so that no task gets all rows of an end.
    """
    known = known.where("id IS NOT NULL").withColumnRenamed("id", "__known")
    if not shared:
        lost = rows.join(known, F.col(column) == F.col("__known"), "left_anti")
    else:
        part = F.pmod(F.xxhash64("id"), F.lit(PARTS))
        dealt = rows.select("id", F.col(column).alias("__end"), part.alias("__part"))
        ends = dealt.where("__end IS NOT NULL").select("__end", "__part").distinct()
        missing = ends.join(known, F.col("__end") == F.col("__known"), "left_anti")
        lost = dealt.where("__end IS NOT NULL").join(missing, ["__end", "__part"], "left_semi").unionByName(dealt.where("__end IS NULL"))
    return lost.select(F.lit(entity).alias("entity"), "id", F.lit(f"UNKNOWN_{column.upper()}").alias("code"))


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """entity, id, code: NULL_ID, DUPLICATE_ID, parents, link ends and flagged rows that aren't there, two pages of one number."""
    found = []
    for name, df in tables.items():
        ids = df.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        code = F.when(F.col("id").isNull(), "NULL_ID").when(F.col("n") > 1, "DUPLICATE_ID")
        found.append(ids.select(F.lit(name).alias("entity"), "id", code.alias("code")).where("code IS NOT NULL"))
    for name, column, parent in PARENTS:
        found.append(_unknown(tables[name], name, column, tables[parent].select("id")))
    citable = reduce(DataFrame.union, [tables[n].select("id") for n in CITABLE])
    for name, column in (("links", "source_id"), ("links", "target_id"), ("review_flags", "entity_id")):
        found.append(_unknown(tables[name], name, column, citable, shared=True))
    twice = tables["pages"].groupBy("revision_id", "page_number").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n > 1")
    found.append(twice.select(F.lit("pages").alias("entity"), "id", F.lit("DUPLICATE_PAGE_NUMBER").alias("code")))
    return reduce(DataFrame.unionByName, found).distinct()


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """entity, n_rows and digest of every table, in columns of ``MANIFEST``."""
    rows = [table_digest(df, _text(df)).select(F.lit(n).alias("entity"), "n_rows", "digest_a", "digest_b") for n, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, rows)


def _text(df: DataFrame) -> Column:
    """All fields of a row as text; boxes as JSON."""
    fields = [F.to_json(F.col(f.name)) if isinstance(f.dataType, T.StructType) else F.col(f.name).cast("string") for f in df.schema]
    return F.concat_ws("\x1f", *[F.coalesce(c, F.lit("\x00")) for c in fields])


def ingest(raw: dict[str, DataFrame], path: str) -> DataFrame:
    """Publish nine entities as one snapshot, or nothing; gives back the manifest.

    Tables are written to a staging folder of this run's own and checked as they were
    written; the manifest is written last, and a rename publishes. What an earlier
    run left behind is in nobody's way. A path that exists is refused.
    """
    spark = raw["documents"].sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    final, staging = jvm.Path(path), jvm.Path(f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}")
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(final):
        raise FileExistsError(path)
    tables, unclear = prepared(raw)
    try:
        for name, df in tables.items():
            df.write.parquet(f"{staging}/{name}")
        written = read_evidence(spark, str(staging))
        bad = unclear.unionByName(violations(written)).groupBy("entity", "code").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).orderBy("entity", "code").collect()
        if bad:
            raise IngestError("; ".join(f"{r['entity']}: {r['n']} x {r['code']}, first {r['id']}" for r in bad))
        manifest(written).coalesce(1).write.parquet(f"{staging}/manifest")
        if not fs.rename(staging, final):
            raise OSError(f"cannot publish {path}")
    except BaseException:
        fs.delete(staging, True)
        raise
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


@dataclass
class Finalized:
    """A published snapshot that agrees with its manifest."""

    tables: dict[str, DataFrame]
    manifest: DataFrame


def validate_finalized(spark: SparkSession, path: str) -> Finalized:
    """Read a snapshot and prove it: all entities are in the manifest with their rows and digests, and no reference is broken."""
    jvm = spark._jvm.org.apache.hadoop.fs
    if not jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm.Path(f"{path}/manifest/_SUCCESS")):
        raise IngestError(f"{path} was never finalized")
    tables, said = read_evidence(spark, path), spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    now = manifest(tables)
    differ = said.exceptAll(now).union(now.exceptAll(said)).select("entity").distinct().orderBy("entity").collect()
    if differ:
        raise IngestError(f"differ from the manifest: {', '.join(r['entity'] for r in differ)}")
    broken = violations(tables).first()
    if broken is not None:
        raise IngestError(f"{broken['entity']} {broken['id']}: {broken['code']}")
    return Finalized(tables, said)
