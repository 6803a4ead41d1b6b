"""Full-text channels over tokens, ranking and fusion, by scans; ``inverted_index`` and ``cascade`` search a stored index.

A channel filters rows in place with array functions, so text never shuffles;
only the top rows of a channel are sorted, ranked and fused.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridock.functions.text import token_text, tokens
from veridock.sources.session import write_kept

#: Weights of the fusion.
CHANNEL_WEIGHTS = {
    "structured_exact": 1.00, "clause_id": 0.95, "rule_source": 0.90, "linked_visual_table": 0.60, "fts_phrase": 0.55, "fts_entity": 0.40,
    "fts_korean_compound": 0.35, "fts_numeric": 0.20, "fts_token_and": 0.15, "fts_token_prefix_and": 0.12, "fts_concept": 0.10, "structural_context": 0.08,
}
#: Parameters of BM25, and the least weight of a term.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, tf, positions, doc_len: the inverted index as a table."""
    flat = df.select(key, tokens(F.col(text)).alias("ws")).select(key, F.size("ws").alias("doc_len"), F.posexplode("ws").alias("pos", "term"))
    return flat.groupBy("term", key, "doc_len").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def has_phrase(text: Column, words: list[str]) -> Column:
    return token_text(text).contains(" " + " ".join(words) + " ")


def has_tokens(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.array_contains("__t", w) for w in words])


def has_prefixes(text: Column, words: list[str]) -> Column:
    def one(w: str) -> Column:
        return F.exists("__t", lambda t: t.startswith(w))

    return reduce(lambda a, b: a & b, [one(w) for w in words])


def _ranked(counted: DataFrame, key: str, n_terms: int, every: bool, k: int) -> DataFrame:
    """key, score: the k best rows by BM25 of ``dl`` tokens and term counts f0, f1, ..., ties by key.

    A term that more than half of the rows have counts almost nothing. Rows need
    every term, or any. Two scans, no shuffle of text; stats are one row.
    """
    terms = range(n_terms)
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"df{i}") for i in terms])

    def part(i: int) -> Column:
        f, df = F.col(f"f{i}"), F.col(f"df{i}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))

    hit = reduce(lambda a, b: a & b if every else a | b, [F.col(f"f{i}") > 0 for i in terms])
    score = F.round(reduce(lambda a, b: a + b, [part(i) for i in terms]), 12)
    return counted.where(hit).crossJoin(F.broadcast(stats)).select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def bm25(df: DataFrame, key: str, text: str, words: list[str], k: int) -> DataFrame:
    """key, score: the k best rows that hold any of the words, by BM25, ties by key."""
    return _ranked(counted(df, key, text, list(dict.fromkeys(words)), "fts_token_and"), key, len(set(words)), False, k)


def _starts_with(word: str) -> Callable[[Column], Column]:
    return lambda x: x.startswith(word)


def counted(df: DataFrame, key: str, text: str, words: list[str], kind: str) -> DataFrame:
    """key, dl, f0, f1, ...: a row's tokens and the places of each term: the whole phrase, a word, or what a word begins."""
    return df.select(key, tokens(F.col(text)).alias("__t")).select(key, F.size("__t").alias("dl"), *[p.alias(f"f{i}") for i, p in enumerate(_places(words, kind))])


def _places(words: list[str], kind: str) -> list[Column]:
    """How often each term of a channel stands in the tokens ``__t``."""
    if kind == "fts_phrase":
        # A space before the phrase is one place of it, also where places overlap.
        body = F.concat(F.lit(" "), F.array_join("__t", " "), F.lit(" "))
        return [F.regexp_count(body, F.lit(" (?=" + " ".join(map(re.escape, words)) + " )"))]
    if kind == "fts_token_and":
        return [F.size("__t") - F.size(F.array_remove("__t", w)) for w in words]
    return [F.size(F.filter("__t", _starts_with(w))) for w in words]


def channel(df: DataFrame, key: str, text: str, words: list[str], kind: str, k: int) -> DataFrame:
    """key, channel, rank, score 1/rank: top k of a channel by BM25 of its terms, ties by key."""
    return _placed(counted(df, key, text, words, kind), key, words, kind, k)


def channels(df: DataFrame, key: str, text: str, words: list[str], kinds: tuple[str, ...], k: int) -> DataFrame:
    """Several channels of the same words. Texts are read and split once: the counts of all terms are a few numbers a row, written to the shared folder for the statistics and the ranks of each channel."""
    places = {kind: _places(words, kind) for kind in kinds}
    base = df.select(key, tokens(F.col(text)).alias("__t"))
    kept = write_kept(base.select(key, F.size("__t").alias("dl"), *[p.alias(f"{kind}{i}") for kind, some in places.items() for i, p in enumerate(some)]))
    parts = [_placed(kept.select(key, "dl", *[F.col(f"{kind}{i}").alias(f"f{i}") for i in range(len(some))]), key, words, kind, k) for kind, some in places.items()]
    return reduce(DataFrame.unionByName, parts)


def _placed(counts: DataFrame, key: str, words: list[str], kind: str, k: int) -> DataFrame:
    top = _ranked(counts, key, 1 if kind == "fts_phrase" else len(words), True, k)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))
    return ranked.select(key, F.lit(kind).alias("channel"), "rank", (1 / F.col("rank")).alias("score"))


def weights_table(spark) -> DataFrame:
    return spark.createDataFrame(list(CHANNEL_WEIGHTS.items()), "channel string, weight double")


def fuse(hits: DataFrame, key: str) -> DataFrame:
    """key, final_score, channels: best score per channel, weighted sum; a channel without a weight is an error."""
    best = hits.groupBy(key, "channel").agg(F.max("score").alias("score"))
    weighted = best.join(F.broadcast(weights_table(hits.sparkSession)), "channel", "left")
    weight = F.when(F.col("weight").isNull(), F.raise_error(F.concat(F.lit("no weight for channel "), F.col("channel"))).cast("double")).otherwise(F.col("weight"))
    return weighted.groupBy(key).agg(F.round(F.sum(weight * F.col("score")), 6).alias("final_score"), F.array_join(F.array_sort(F.collect_set("channel")), "|").alias("channels"))


def merge_details(hits: DataFrame, key: str) -> DataFrame:
    """Per key and channel the best score and all details, joined in order."""
    return hits.groupBy(key, "channel").agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("detail")), " | ").alias("detail"))


def neighbours(df: DataFrame, group: str, order: str, seeds: DataFrame, radius: int) -> DataFrame:
    """Rows within ``radius`` places of a seed in the same group, seeds left out: an equi-join on group and place."""
    near = seeds.select(group, F.explode(F.sequence(F.col(order) - radius, F.col(order) + radius)).alias(order), F.col(order).alias("seed")).where(F.col(order) != F.col("seed"))
    return df.join(near, [group, order])
