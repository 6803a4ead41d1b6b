"""Written references of legal texts, resolved to documents and to places in them; what is missing stays as a link of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridock.functions.text import collapse, compatibility_text

#: A quoted title with its article, paragraph and annex; the anchors that a place in a document begins with.
REFERENCE = r"「([^」]+)」(?:\s*(제\d+조(?:의\d+)?))?(?:\s*(제\d+항))?(?:[^「」\n]{0,40}?(별표\s*\d+))?"
WRAPPERS = r"^[\[({<【〈《]+"
#: Fixed value: targets of one reference.
MAX_TARGETS = 5
#: Characters that two titles, one inside the other, are brought together by.
GRAM = 4


def canonical_title(col: Column) -> Column:
    """Compatibility form, lower case, letters of a-z and Hangul and digits only."""
    return F.regexp_replace(F.lower(compatibility_text(col)), "[^0-9a-z가-힣]", "")


def compact(col: Column) -> Column:
    """Compatibility form without spaces and without brackets at its start."""
    return F.regexp_replace(F.regexp_replace(compatibility_text(F.coalesce(col, F.lit(""))), r"\s", ""), WRAPPERS, "")


def extract_references(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, ord, title, article, paragraph, annex: distinct references of each text in order of their first place. Only quoted titles count."""
    groups = [F.regexp_extract_all(text, F.lit(REFERENCE), g) for g in (1, 2, 3, 4)]
    flat = texts.select(key, F.posexplode(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("t", "a", "p", "x"), strict=True)])).alias("ord", "r"))
    said = lambda c: F.nullif(collapse(F.col(c)), F.lit(""))
    named = flat.select(key, "ord", said("r.t").alias("title"), said("r.a").alias("article"), said("r.p").alias("paragraph"), said("r.x").alias("annex")).where("title IS NOT NULL")
    return named.groupBy(key, "title", "article", "paragraph", "annex").agg(F.min("ord").alias("ord"))


def _grams(col: Column, size: int) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.length(col) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(places, lambda i: F.substring(col, i, F.lit(size))))


def _inside(short: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs (s, l) of titles where s stands in l, brought together by the first characters of s."""
    heads = short.select("s", F.substring("s", 1, GRAM).alias("gram")).where("s <> ''")
    places = long.select("l", F.explode(F.array_distinct(F.flatten(F.array(*[_grams(F.col("l"), n) for n in range(1, GRAM + 1)])))).alias("gram"))
    return heads.join(places, "gram").where(F.col("l").contains(F.col("s"))).select("s", "l")


def resolve_titles(titles: DataFrame, documents: DataFrame) -> DataFrame:
    """title, document: the one document (document, title) of that canonical title, else the one whose title holds it or stands in it; null if there is none or more than one."""
    # A title is brought into its form once, however many references name it.
    wanted = titles.select("title").distinct().select("title", canonical_title(F.col("title")).alias("w"))
    known = documents.select("document", canonical_title(F.col("title")).alias("k"))
    only = F.when(F.count(F.lit(1)) == 1, F.min("document"))
    exact = known.groupBy("k").agg(only.alias("exact")).withColumnRenamed("k", "w")
    names, asked = known.select("k").distinct(), wanted.select("w").distinct()
    down = _inside(asked.select(F.col("w").alias("s")), names.select(F.col("k").alias("l"))).select(F.col("s").alias("w"), F.col("l").alias("k"))
    up = _inside(names.select(F.col("k").alias("s")), asked.select(F.col("w").alias("l"))).select(F.col("l").alias("w"), F.col("s").alias("k"))
    near = down.union(up).distinct().join(known, "k").groupBy("w").agg(only.alias("near"))
    return wanted.join(exact, "w", "left").join(near, "w", "left").select("title", F.coalesce("exact", "near").alias("document"))


def anchors(places: DataFrame) -> DataFrame:
    """document, evidence, anchor, body: what the title or the text of a place (document, evidence, title, text) begins with.

    A place that begins with 제20조의2 is found under 제20조, too.
    """
    heads = F.array(compact(F.col("title")), compact(F.col("text")))
    rows = places.select("document", "evidence", F.array_join(heads, " ").alias("body"), heads.alias("heads"))
    found = F.flatten(F.transform("heads", lambda h: F.array(F.regexp_extract(h, r"^제\d+조", 0), F.regexp_extract(h, r"^제\d+조의\d+", 0), F.regexp_extract(h, r"^별표\d+", 0))))
    return rows.select("document", "evidence", "body", F.explode(F.array_distinct(found)).alias("anchor")).where("anchor <> ''")


def _missing(prefix: str, *parts: str) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.upper(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 24)))


def reference_links(references: DataFrame, documents: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """key, title, article, paragraph, annex, target, relation: links of references, at most five targets each.

    ``rule_source`` leads to places of the document; ``reference_target_missing`` says
    that the document is there and the place isn't, or none is named;
    ``source_not_ingested`` that no document, or no single one, has the title.
    """
    shown = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "article", "paragraph", "annex")])
    cols = [key, "title", "article", "paragraph", "annex"]
    found = references.select(*cols, shown.alias("ref")).join(resolve_titles(references.select("title"), documents), "title")
    anchor = F.coalesce(F.regexp_replace("annex", r"\s", ""), F.col("article"))
    distinct = found.where("document IS NOT NULL").select("ref", "document", anchor.alias("anchor"), F.when(F.col("annex").isNull(), F.col("paragraph")).alias("inner")).distinct()
    hits = distinct.join(anchors(places), ["document", "anchor"]).where(F.col("inner").isNull() | F.col("body").contains(F.col("inner"))).select("ref", "evidence").distinct()
    few = hits.withColumn("n", F.row_number().over(Window.partitionBy("ref").orderBy("evidence"))).where(F.col("n") <= MAX_TARGETS).drop("n")
    linked = found.join(few, "ref", "left")
    relation = F.when(F.col("document").isNull(), "source_not_ingested").when(F.col("evidence").isNull(), "reference_target_missing").otherwise("rule_source")
    target = F.when(F.col("document").isNull(), _missing("MISSING-SOURCE", "ref")).when(F.col("evidence").isNull(), _missing("MISSING-REFERENCE", "document", "ref")).otherwise(F.col("evidence").cast("string"))
    return linked.select(*cols, target.alias("target"), relation.alias("relation"))
