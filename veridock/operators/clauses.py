"""Clauses of legal texts from their lines: levels, ancestor paths, siblings and citations inside an article.

A line opens an article, an operational standard or an appendix, is a paragraph of
an article, an item under a standard, or continues what stands before it. What a
line means depends on the lines before it only through the last line of some kind,
so the state is carried by windows over a revision's lines, without a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridock.functions.text import collapse

#: How the lines begin that have a place in the hierarchy, and the marks of paragraphs 1 to 20.
ARTICLE = r"^\s*(제\d+조(?:의\d+)?)(?:\s*\(([^)]*)\))?\s*((?s:.*))$"
STANDARD = r"^\s*(\d+(?:-\d+){1,3})\.\s*((?s:.*))$"
LETTER_DOT = r"^\s*([가-힣])\.\s*((?s:.*))$"
NUMBER_PAREN = r"^\s*(\d+)\)\s*((?s:.*))$"
LETTER_PAREN = r"^\s*([가-힣])\)\s*((?s:.*))$"
APPENDIX = r"^\s*(?:부록|붙임|별첨)(?![0-9A-Za-z_가-힣])(?:\s*[:：\-]?\s*((?s:.*)))?$"
MARKS = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
PARAGRAPH_REFERENCE = r"제(\d+)항"

PART = "array<struct<key:string,title:string,text:string>>"
#: Lines of a task, on average.
LINES_A_TASK = 200_000


def by_revision(lines: DataFrame) -> DataFrame:
    """Lines dealt by revision to tasks of about ``LINES_A_TASK``, however well they compress. What groups by revision needs no further shuffle."""
    return lines.repartition(max(-(-lines.count() // LINES_A_TASK), lines.sparkSession.sparkContext.defaultParallelism), "revision")


def _paragraphs(text: Column) -> Column:
    """(number, text) of the paragraphs of a line, from each mark to the next; what stands before the first is left out."""
    pieces = F.regexp_extract_all(text, F.lit(f"([{MARKS}][^{MARKS}]*)"), 1)
    return F.transform(pieces, lambda p: F.struct(F.instr(F.lit(MARKS), F.substring(p, 1, 1)).alias("n"), F.trim(p).alias("text")))


def _one(key: Column, title: Column, text: Column) -> Column:
    return F.array(F.struct(key.alias("key"), F.trim(title).alias("title"), text.alias("text")))


def classified(lines: DataFrame) -> DataFrame:
    """Lines (revision, pos, element, text) with the state that holds at each: region, article, standard, letter, number.

    A region is opened by an appendix, an article or a standard. A standard's line
    that has paragraph marks opens one only outside an article: there it is a
    paragraph.
    """
    rows = lines.select("revision", "pos", "element", collapse(F.col("text")).alias("text")).where("revision IS NOT NULL AND element IS NOT NULL AND text <> ''")
    marked = F.col("text").rlike(f"[{MARKS}]")
    sure = F.when(F.col("text").rlike(APPENDIX), "appendix").when(F.col("text").rlike(ARTICLE), "article").when(F.col("text").rlike(STANDARD) & ~marked, "standard")
    order = Window.partitionBy("revision").orderBy("pos", "element").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sure", sure).withColumn("base", F.last("sure", ignorenulls=True).over(order))
    opens = F.coalesce("sure", F.when(F.col("text").rlike(STANDARD) & (F.coalesce("base", F.lit("")) != "article"), "standard"))
    rows = rows.withColumn("opens", opens).withColumn("region", F.count("opens").over(order)).withColumn("kind", F.last("opens", ignorenulls=True).over(order))

    def opened(pattern: str, group: int, kind: str) -> Column:
        """A part of the region's opening line."""
        return F.last(F.when(F.col("opens") == kind, F.regexp_extract("text", pattern, group)), ignorenulls=True).over(order)

    inner = F.col("opens").isNull() & (F.col("kind") == "standard")
    rows = rows.withColumns({
        "article": F.when(F.col("kind") == "article", opened(ARTICLE, 1, "article")),
        "heading": F.when(F.col("kind") == "article", F.trim(opened(ARTICLE, 2, "article"))),
        "bare": (F.col("kind") == "article") & (opened(ARTICLE, 3, "article") == ""),
        "standard": F.when(F.col("kind") == "standard", opened(STANDARD, 1, "standard")),
        "item": F.when(inner & F.col("text").rlike(LETTER_DOT), "letter").when(inner & F.col("text").rlike(NUMBER_PAREN), "number").when(inner & F.col("text").rlike(LETTER_PAREN), "leaf"),
    })
    region = Window.partitionBy("revision", "region").orderBy("pos", "element").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("letters", F.count(F.when(F.col("item") == "letter", 1)).over(region)).withColumn("letter", F.last(F.when(F.col("item") == "letter", F.regexp_extract("text", LETTER_DOT, 1)), ignorenulls=True).over(region))
    block = Window.partitionBy("revision", "region", "letters").orderBy("pos", "element").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("number", F.last(F.when(F.col("item") == "number", F.regexp_extract("text", NUMBER_PAREN, 1)), ignorenulls=True).over(block)).withColumn("nth", F.row_number().over(Window.partitionBy("revision", "region").orderBy("pos", "element")))


def derive_clauses(lines: DataFrame) -> DataFrame:
    """revision, ord, id, key, path, title, article, text, sources: clauses of lines (revision, pos, element, text) in order.

    key is the clause's place (제3조#2, 1-2/가/1, APPENDIX:...), path its ancestors
    from the top. Text lines belong to the clause before them. Lines before the first
    opening belong to none. Null and empty lines are passed over; lines at one pos
    come in order of their element. Lines from ``by_revision`` keep a task's memory
    within bounds.
    """
    rows = classified(lines)
    text, article = F.col("text"), F.col("article")
    named = F.when(F.col("heading") != "", F.concat(article, F.lit("("), F.col("heading"), F.lit(")"))).otherwise(article)
    rest = F.when(F.col("opens") == "article", F.regexp_extract("text", ARTICLE, 3)).otherwise(text)
    paragraphs = F.transform(_paragraphs(rest), lambda p: F.struct(F.concat(article, F.lit("#"), p["n"]).alias("key"), F.concat(named, F.lit(" 제"), p["n"], F.lit("항")).alias("title"), p["text"].alias("text")))
    after = F.trim(F.regexp_extract("text", APPENDIX, 1))
    appendix = _one(F.when(after != "", F.concat(F.lit("APPENDIX:"), after)).otherwise("APPENDIX"), text, text)

    def leaf(path: Column, pattern: str) -> Column:
        left = F.trim(F.regexp_extract("text", pattern, 2))
        return _one(path, F.concat_ws(" ", path, left), F.when(left != "", left).otherwise(text))

    standard = F.col("standard")
    parts = (
        F.when(F.col("opens") == "appendix", appendix)
        .when((F.col("opens") == "article") & (rest == ""), F.array().cast(PART))
        .when((F.col("kind") == "article") & rest.rlike(f"[{MARKS}]"), paragraphs)
        .when(F.col("opens") == "article", _one(article, named, rest))
        .when(F.col("opens") == "standard", leaf(standard, STANDARD))
        .when(F.col("item") == "letter", leaf(F.concat_ws("/", standard, "letter"), LETTER_DOT))
        .when(F.col("item") == "number", leaf(F.concat_ws("/", standard, "letter", "number"), NUMBER_PAREN))
        .when(F.col("item") == "leaf", leaf(F.concat_ws("/", standard, "letter", "number", F.regexp_extract("text", LETTER_PAREN, 1)), LETTER_PAREN))
        .when(F.col("bare") & (F.col("nth") == 2), _one(article, named, text))
        .otherwise(F.array().cast(PART))
    )
    flat = rows.select("revision", "pos", "element", "text", "article", "opens", F.posexplode_outer(parts).alias("part", "p"))
    order = Window.partitionBy("revision").orderBy("pos", "element", F.coalesce("part", F.lit(0))).rowsBetween(Window.unboundedPreceding, 0)
    # An article's heading without text begins nothing and continues nothing.
    held = flat.withColumn("ord", F.count("p").over(order)).where("ord > 0 AND (p IS NOT NULL OR opens IS NULL)")
    pieces = F.array_sort(F.collect_list(F.struct("pos", "element", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("p.text", "text").alias("t"))))
    first = lambda c: F.max(F.when(F.col("p").isNotNull(), c))
    made = held.groupBy("revision", "ord").agg(first(F.col("p.key")).alias("key"), first(F.col("p.title")).alias("title"), first(F.col("article")).alias("article"), pieces.alias("pieces"))
    whole = made.withColumn("text", F.array_join(F.transform("pieces", lambda x: x["t"]), " ")).withColumn("sources", F.array_distinct(F.transform("pieces", lambda x: x["element"])))
    steps = F.split(F.regexp_replace("key", "#", "/"), "/")
    path = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    ident = F.concat(F.lit("AUTO-CLAUSE-"), F.upper(F.substring(F.sha2(F.concat_ws("\x1f", F.col("revision").cast("string"), "key", "text"), 256), 1, 24)))
    return whole.select("revision", "ord", ident.alias("id"), "key", F.when(F.col("key").startswith("APPENDIX"), F.array("key")).otherwise(path).alias("path"), "title", "article", "text", "sources")


def clause_links(clauses: DataFrame) -> DataFrame:
    """source, target, relation: clauses to their elements, to the next and previous of their article, to the paragraphs of it that they name, and the same between elements."""
    own = clauses.select(F.col("id").alias("source"), F.explode("sources").alias("target"), F.lit("source_element").alias("relation"))
    inside = clauses.where("article IS NOT NULL")
    order = Window.partitionBy("revision", "article").orderBy("ord")
    beside = inside.select("id", F.lead("id").over(order).alias("next_sibling"), F.lag("id").over(order).alias("previous_sibling"))
    beside = beside.unpivot("id", ["next_sibling", "previous_sibling"], "relation", "target").where("target IS NOT NULL").select(F.col("id").alias("source"), "target", "relation")
    number = F.regexp_extract("key", "#([0-9]+)$", 1)
    # Of paragraphs that repeat a number the last one counts.
    named = inside.where(number != "").groupBy("revision", "article", number.cast("int").alias("n")).agg(F.max_by(F.struct("id", "sources"), "ord").alias("t"))
    cites = inside.select("revision", "article", "id", "sources", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(PARAGRAPH_REFERENCE), 1))).alias("n")).withColumn("n", F.col("n").try_cast("int"))
    cited = cites.join(named, ["revision", "article", "n"]).where(F.col("id") != F.col("t.id"))
    relation = F.lit("cited_clause").alias("relation")
    between = cited.select(F.explode("sources").alias("source"), "t").select("source", F.explode("t.sources").alias("target"), relation).where("source <> target")
    return own.unionByName(beside).unionByName(cited.select(F.col("id").alias("source"), F.col("t.id").alias("target"), relation)).unionByName(between).distinct()
