"""Sources and sinks of evidence: typed tables, CSV, parser JSON, HTML, inventories, staged publishing."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridock.functions.canonical import content_id, row_text, table_digest
from veridock.operators.ranks import group_ranks
from veridock.sources.session import ensure_checkpoint_dir

BOX = "struct<left:double,bottom:double,right:double,top:double>"
#: Current schema (version 4) by entity.
SCHEMAS = {
    "documents": "id string, title string",
    "revisions": "id string, document_id string, source_hash string, byte_size long, page_count int",
    "pages": "id string, revision_id string, page_number int, width double, height double, origin_x double, origin_y double, rotation int, box_kind string",
    "elements": f"id string, page_id string, element_type string, raw_json string, raw_text string, bbox {BOX}, parser_order int",
    "clauses": "id string, revision_id string, title string, text string, review_status string",
    "tables": "id string, page_id string, raw_json string, normalized_json string",
    "visuals": f"id string, page_id string, kind string, sha256 string, duplicate_group string, bbox {BOX}",
    "links": "id string, source_id string, target_id string, relation_type string",
    "review_flags": "id string, entity_id string, code string, status string",
}
#: What older versions lack: entity, column and default.
ADDED = {2: [], 3: [("pages", "origin_x", 0.0), ("pages", "origin_y", 0.0), ("pages", "rotation", 0), ("pages", "box_kind", "MEDIA")], 4: [("clauses", "review_status", "AUTOMATIC")]}


def schema_version(tables: dict[str, DataFrame]) -> int:
    """Version of a set of tables from their exact columns; anything else is refused."""
    want = {n: {f.name for f in T.StructType.fromDDL(s)} for n, s in SCHEMAS.items()}
    for version in (4, 3, 2):
        gone = {(e, c) for v, cs in ADDED.items() if v > version for e, c, _ in cs}
        if all(n in tables and set(tables[n].columns) == {c for c in cols if (n, c) not in gone} for n, cols in want.items()):
            return version
    raise ValueError("not a known evidence schema")


def migrate(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Bring tables to the current version: columns that are missing get their defaults."""
    version = schema_version(tables)
    out = dict(tables)
    for v, columns in ADDED.items():
        for entity, column, default in columns:
            if v > version:
                out[entity] = out[entity].withColumn(column, F.lit(default))
    return {n: df.select(*[f.name for f in T.StructType.fromDDL(SCHEMAS[n])]) for n, df in out.items()}


def read_evidence(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All entities of a published snapshot, with explicit schemas."""
    return {n: spark.read.schema(s).parquet(f"{path}/{n}") for n, s in SCHEMAS.items()}


def publish(tables: dict[str, DataFrame], path: str) -> None:
    """Write entities to a staging folder of this run's own and rename it: all or nothing, and never over an existing one. ``ingest`` checks what it publishes, too."""
    spark = next(iter(tables.values())).sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    final, staging = jvm.Path(path), jvm.Path(f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}")
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(final):
        raise FileExistsError(path)
    try:
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{staging}/{name}")
        if not fs.rename(staging, final):
            raise OSError(f"cannot publish {path}")
    except BaseException:
        fs.delete(staging, True)
        raise


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns text, blanks for nulls; a byte-order mark is ignored."""
    return spark.read.csv(path, header=True, encoding="UTF-8").na.fill("")


def first_of(df: DataFrame, *aliases: str) -> Column:
    """First non-blank column among aliases, names compared without case; blank if none is there."""
    names = {c.lower().lstrip("﻿"): c for c in df.columns}
    found = [F.nullif(F.trim(F.col(f"`{names[a.lower()]}`")), F.lit("")) for a in aliases if a.lower() in names]
    return F.coalesce(*found, F.lit(""))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256, category of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    category = F.when(suffix == "csv", "table").when(suffix.isin("json", "jsonl"), "parser_output").when(suffix == "pdf", "source").when(suffix.isin("png", "jpg", "jpeg"), "image").otherwise("other")
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), category.alias("category"), mime_type(F.col("content")).alias("mime"))


def mime_type(content: Column) -> Column:
    """MIME type by the first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("25504446"), "application/pdf").when(head == "89504E470D0A1A0A", "image/png").when(head.startswith("FFD8FF"), "image/jpeg")


def verify_inventory(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path, code of files that are missing, new, or differ in size or hash."""
    e, a = expected.select("path", F.col("size").alias("e_size"), F.col("sha256").alias("e_hash")), actual.select("path", "size", "sha256")
    code = F.when(F.col("sha256").isNull(), "MISSING").when(F.col("e_hash").isNull(), "UNDECLARED").when(F.col("size") != F.col("e_size"), "SIZE_MISMATCH").when(F.col("sha256") != F.col("e_hash"), "HASH_MISMATCH")
    return e.join(a, "path", "full").select("path", code.alias("code")).where("code IS NOT NULL")


def dedupe_sources(sources: DataFrame) -> DataFrame:
    """One row per hash (source_hash, id, parser), preferring one with a parser, then the smallest id; ``conflict`` if parsers disagree."""
    has = F.when(F.col("parser").isNotNull(), 0).otherwise(1)
    best = F.min(F.struct(has.alias("p"), "id", "parser")).alias("b")
    return sources.groupBy("source_hash").agg(best, F.count(F.lit(1)).alias("n"), (F.count_distinct("parser") > 1).alias("conflict")).select("source_hash", "b.id", "b.parser", "n", "conflict")


def split_links(links: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``code``: null for links with both ends known, else which end is missing."""
    s, t = known.select(F.col("id").alias("source"), F.lit(True).alias("__s")), known.select(F.col("id").alias("target"), F.lit(True).alias("__t"))
    code = F.when(F.col("__s").isNull() & F.col("__t").isNull(), "BOTH_MISSING").when(F.col("__s").isNull(), "SOURCE_MISSING").when(F.col("__t").isNull(), "TARGET_MISSING")
    return links.join(s, "source", "left").join(t, "target", "left").withColumn("code", code).drop("__s", "__t")


def lint(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """code, n: how many rows fail each check."""
    flags = F.filter(F.array(*[F.when(c, F.lit(code)) for code, c in checks.items()]), lambda x: x.isNotNull())
    return rows.select(F.explode(flags).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def html_elements(pages: DataFrame, tags: tuple[str, ...] = ("title", "h1", "h2", "h3", "p", "li", "td")) -> DataFrame:
    """page_id, ordinal, tag, text: elements of raw pages in order, scripts and styles left out.

    An element's text runs to the next start or end of one of the tags; other tags
    inside it are dropped and their text stays.
    """
    body = F.regexp_replace("html", r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    # Starts and ends of the wanted tags become marks before all other tags go.
    marked = F.regexp_replace(body, rf"(?is)<(/?)({'|'.join(tags)})\b[^>]*>", "\x01$1$2\x02")
    plain = F.regexp_replace(F.regexp_replace(marked, r"(?is)<br\b[^>]*>", " "), "<[^>]*>", "")
    pieces = F.filter(F.split(plain, "\x01"), lambda x: x.contains("\x02") & ~x.startswith("/"))
    flat = pages.select("page_id", F.posexplode(pieces).alias("pos", "piece"))
    text = F.regexp_replace(F.substring_index("piece", "\x02", -1), r"\s+", " ")
    return flat.select("page_id", (F.col("pos") + 1).alias("ordinal"), F.lower(F.substring_index("piece", "\x02", 1)).alias("tag"), F.trim(text).alias("text"))


def tree_elements(files: DataFrame, document_id: str, revision_id: str) -> DataFrame:
    """Parser trees (column ``content``, JSON text) to flat elements with page-local stable ids.

    A tree is opened level by level, as rows, to the depth of the deepest file; a
    node's kids are its ``kids``, or else its ``list items``. Nodes with a type and a
    page come out in the order of the text: page_number, parser_order (within file
    and page), element_type, text, bbox, element_id. A file that is no JSON is an error.
    """
    ensure_checkpoint_dir(files.sparkSession)
    roots = files.select(F.monotonically_increasing_id().alias("file"), F.array().cast("array<int>").alias("path"), F.parse_json("content").alias("v"))
    level, found = roots.checkpoint(), []

    def kids(name: str) -> Column:
        part = F.try_variant_get("v", f'$["{name}"]', "array<variant>")
        return F.when(F.size(part) > 0, part)

    while True:
        page = F.try_variant_get("v", '$["page number"]', "int")
        made = level.select("file", "path", page.alias("page_number"), F.try_variant_get("v", "$.type", "string").alias("element_type"), F.coalesce(F.try_variant_get("v", "$.content", "string"), F.lit("")).alias("text"), F.coalesce(F.try_variant_get("v", '$["bounding box"]', "array<double>"), F.array().cast("array<double>")).alias("bbox"))
        found.append(made.where("page_number <> 0 AND element_type <> ''"))
        level = level.select("file", "path", F.posexplode(F.coalesce(kids("kids"), kids("list items"))).alias("place", "v")).select("file", F.concat("path", F.array("place")).alias("path"), "v")
        if level.isEmpty():
            break
    ranked = group_ranks(reduce(DataFrame.unionByName, found), ["file", "page_number"], ["path"], "parser_order")
    flat = ranked.select("page_number", F.col("parser_order").cast("int").alias("parser_order"), "element_type", "text", "bbox")
    payload = F.concat_ws("\x1f", F.lit(revision_id), "page_number", "parser_order", "element_type")
    return flat.select(F.lit(document_id).alias("document_id"), "*", content_id("ELEM-", payload, 24).alias("element_id"))


def table_cells(tables: DataFrame) -> DataFrame:
    """table_id, row_number, column_number, row_span, column_span, text of tables with nested rows and cells."""
    rows = tables.select("table_id", F.explode("rows").alias("r"))
    cells = rows.select("table_id", F.col("r.row_number").alias("row_number"), F.explode("r.cells").alias("c"))
    return cells.select("table_id", "row_number", "c.column_number", F.coalesce("c.row_span", F.lit(1)).alias("row_span"), F.coalesce("c.column_span", F.lit(1)).alias("column_span"), "c.text")


def table_text(rows: Column) -> Column:
    """Rows and cells of a nested table as search text: cells by tabs, rows by line breaks."""
    return F.array_join(F.transform(F.array_sort(rows), lambda r: F.array_join(F.transform(F.array_sort(r["cells"]), lambda c: c["text"]), "\t")), "\n")


class ParserRegistry:
    """Readers by kind: functions of (spark, path) to a dict of DataFrames."""

    def __init__(self) -> None:
        self.readers: dict[str, Callable[[SparkSession, str], dict[str, DataFrame]]] = {}

    def register(self, kind: str, reader: Callable[[SparkSession, str], dict[str, DataFrame]]) -> None:
        if kind in self.readers:
            raise ValueError(f"parser kind {kind} is registered")
        self.readers[kind] = reader

    def read(self, kind: str, spark: SparkSession, path: str) -> dict[str, DataFrame]:
        return self.readers[kind](spark, path)


#: What is masked before an artefact is compared or shown.
SECRETS = [
    (r"(?i)\b(password|token|secret|api[_-]?key)\s*[:=]\s*\S+", "$1=[REDACTED]"),
    (r"(?<![\w/])(?:/home|/root|/Users|/tmp)/[^\s\"']+", "[PATH]"),
    (r"[A-Za-z]:\\[^\s\"']+", "[PATH]"),
    (r"https?://(?:localhost|127\.0\.0\.1|\[::1\])(?::\d+)?[^\s\"']*", "[LOOPBACK]"),
]


def sanitize(col: Column) -> Column:
    """Redact secrets, local paths and loopback URLs of a text."""
    for pattern, to in SECRETS:
        col = F.regexp_replace(col, pattern, to)
    return col


def snapshot_digest(tables: dict[str, DataFrame]) -> DataFrame:
    """entity, n_rows and digest of each table of a snapshot."""
    parts = []
    for name, df in tables.items():
        flat = df.select(*[F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, T.StructType) else F.col(c) for c in df.columns])
        parts.append(table_digest(flat, row_text(flat)).select(F.lit(name).alias("entity"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
