"""The hybrid bundle: all channels of a retrieval over the stored index and the tables beside it, fused by fixed weights.

Every channel gives (q, key, channel, rank, score) with score 1/rank, for all
queries at once. Lexical channels look their terms up in the index; the others are
equi-joins with labels, identifiers, links and places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridock.functions.numbers import numeric_texts
from veridock.functions.text import collapse, compounds, grouped_number, tokens
from veridock.operators import inverted_index
from veridock.operators.inverted_index import Index
from veridock.operators.search import fuse

#: What names an entity in a query, and a clause's number.
ENTITY = "[「『\"“]([^」』\"”]+)[」』\"”]"
CLAUSE_ID = r"제\d+조(?:의\d+)?|\d+(?:-\d+){1,3}"


def _placed(found: DataFrame, channel: str, k: int) -> DataFrame:
    """The k best of each query as rows of a channel."""
    top = inverted_index.ranked(found, k)
    return top.select("q", "key", F.lit(channel).alias("channel"), "rank", (1 / F.col("rank")).alias("score"))


def any_of(index: Index, queries: DataFrame, kind: str, channel: str, k: int) -> DataFrame:
    """A channel of alternatives (q, alternatives: texts), each searched by itself; a document counts by its best one."""
    each = queries.select("q", F.explode(F.array_distinct("alternatives")).alias("a")).select("q", "a", tokens(F.col("a")).alias("terms")).where(F.size("terms") > 0)
    found = inverted_index.matches(index, each.select(F.struct("q", "a").alias("q"), "terms"), kind, k)
    return _placed(found.groupBy(F.col("q.q").alias("q"), "key").agg(F.max("score").alias("score")), channel, k)


def equal_to(queries: DataFrame, names: DataFrame, channel: str, k: int) -> DataFrame:
    """A channel of names: queries (q, name) and documents (key, name) that have one in common, compared after white space."""
    named = names.select("key", collapse(F.col("name")).alias("name")).where("name <> ''").distinct()
    found = queries.select("q", collapse(F.col("name")).alias("name")).distinct().join(named, "name").select("q", "key").distinct()
    return _placed(found.withColumn("score", F.lit(1.0)), channel, k)


def linked(hits: DataFrame, links: DataFrame, channel: str, k: int) -> DataFrame:
    """What hits (q, key, score) lead to by links (source, target), each by its best hit."""
    found = hits.join(links.select(F.col("source").alias("key"), "target").distinct(), "key").groupBy("q", F.col("target").alias("to")).agg(F.max("score").alias("score"))
    return _placed(found.withColumnRenamed("to", "key"), channel, k)


def beside(hits: DataFrame, places: DataFrame, radius: int, channel: str, k: int) -> DataFrame:
    """Documents within ``radius`` places of a hit in its group, nearest first, hits left out. ``places``: key, group, pos."""
    seeds = hits.select("q", "key").distinct()
    at = seeds.join(places, "key").select("q", "group", "pos", F.explode(F.array(*[F.lit(d) for d in range(-radius, radius + 1) if d])).alias("d"))
    wanted = at.select("q", "group", (F.col("pos") + F.col("d")).alias("pos"), F.abs("d").alias("far")).groupBy("q", "group", "pos").agg(F.min("far").alias("far"))
    found = wanted.join(places, ["group", "pos"]).select("q", "key", (-F.col("far")).cast("double").alias("score")).join(seeds, ["q", "key"], "left_anti")
    return _placed(found, channel, k)


def _texts(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def bundle(index: Index, queries: DataFrame, k: int, labels: DataFrame | None = None, clause_ids: DataFrame | None = None, rule_sources: DataFrame | None = None, links: DataFrame | None = None, places: DataFrame | None = None, concepts: DataFrame | None = None, radius: int = 1) -> DataFrame:
    """q, key, channel, rank, score of queries (q, text): every channel that its tables allow.

    ``labels`` and ``clause_ids``: key, name. ``rule_sources``: q, key. ``links``:
    source, target to tables and visuals. ``places``: key, group, pos. ``concepts``:
    word, other: what may stand for a word.
    """
    rows = queries.select("q", collapse(F.col("text")).alias("text"), tokens(F.col("text")).alias("terms")).checkpoint()
    asked = rows.where(F.size("terms") > 0)
    lexical = inverted_index.channels(index, asked.select("q", "terms"), k).checkpoint()
    numbers = numeric_texts("text")
    spelled = F.flatten(F.transform(F.filter(numbers, lambda n: n.rlike("^[0-9][0-9,]*$")), grouped_number))
    parts = [
        lexical,
        any_of(index, rows.select("q", _texts(F.regexp_extract_all("text", F.lit(ENTITY), 1)).alias("alternatives")), "phrase", "fts_entity", k),
        any_of(index, rows.select("q", compounds(F.col("terms")).alias("alternatives")), "tokens", "fts_korean_compound", k),
        # A number that is grouped falls into several tokens: all of them in a row.
        any_of(index, rows.select("q", _texts(F.array_distinct(F.concat(numbers, spelled))).alias("alternatives")), "phrase", "fts_numeric", k),
    ]
    if concepts is not None:
        words = rows.select("q", "text", F.posexplode("terms").alias("at", "word")).join(concepts, "word")
        said = words.select("q", F.replace(F.concat(F.lit(" "), F.array_join(tokens(F.col("text")), " "), F.lit(" ")), F.concat(F.lit(" "), "word", F.lit(" ")), F.concat(F.lit(" "), "other", F.lit(" "))).alias("a"))
        parts.append(any_of(index, said.groupBy("q").agg(F.collect_set("a").alias("alternatives")), "tokens", "fts_concept", k))
    if labels is not None:
        parts.append(equal_to(rows.select("q", F.col("text").alias("name")), labels, "structured_exact", k))
    if clause_ids is not None:
        parts.append(equal_to(rows.select("q", F.explode(F.regexp_extract_all("text", F.lit(f"({CLAUSE_ID})"), 1)).alias("name")), clause_ids, "clause_id", k))
    if rule_sources is not None:
        parts.append(_placed(rows.select("q").join(rule_sources.select("q", "key").distinct(), "q").withColumn("score", F.lit(1.0)), "rule_source", k))
    if links is not None:
        parts.append(linked(lexical, links, "linked_visual_table", k))
    if places is not None:
        parts.append(beside(lexical, places, radius, "structural_context", k))
    return reduce(DataFrame.unionByName, parts)


def fused(hits: DataFrame, k: int) -> DataFrame:
    """q, key, final_score, channels, rank: the k best documents of each query over all channels."""
    made = fuse(hits.select(F.struct("q", "key").alias("hit"), "channel", "rank", "score"), "hit").select("hit.q", "hit.key", "final_score", "channels")
    order = Window.partitionBy("q").orderBy(F.desc("final_score"), "key")
    return made.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
