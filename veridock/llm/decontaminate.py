"""Benchmark decontamination by prefix-filtered set join (native).

Every benchmark item is a list of windows of ``window`` consecutive words. A
window can only occur where all its words do, so the necessary prefix under full
containment is one token: the window's rarest word, counted over all documents.
Document words join that prefix token only; length and positional bounds then
place the window, and the words there are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import back, broadcast_if_small, by_position, checkpoint, join_hot, pick, word_array

WINDOW = 10


def item_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id (as string) and gram: item-sized windows; an item without words has none."""
    items = pick(bench, item_id="item_id", text="text").select(F.col("item_id").cast("string").alias("item_id"), word_array(F.col("text")).alias("ws"))
    n = F.greatest(F.size("ws") - window, F.lit(0))
    grams = F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.slice("ws", i, window))
    return items.where(F.size("ws") > 0).select("item_id", F.explode(grams).alias("gram"))


def find_windows(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """Exact occurrences: doc_id, th, start, stop, gid of windows (gid, gram) in whole texts."""
    words = pick(docs, doc_id="doc_id", text="text").select("doc_id", F.xxhash64("text").alias("th"), word_array(F.col("text")).alias("ws"))
    vocabulary = checkpoint(grams.select(F.explode("gram").alias("word")).distinct())
    vocabulary, _ = broadcast_if_small(vocabulary, F.octet_length("word") + 64)
    counts = words.select(F.explode("ws").alias("word")).join(vocabulary, "word", "left_semi").groupBy("word").count()
    rarity = checkpoint(grams.select("gid", F.posexplode("gram").alias("offset", "word")).join(counts, "word"))
    # A word of the window that no document has rules the window out: it leaves fewer ranked words than the window has.
    best = rarity.groupBy("gid").agg(F.min(F.struct("count", "word", "offset")).alias("p"), F.count(F.lit(1)).alias("found"))
    keys = (
        grams.join(best, "gid")
        .where(F.col("found") == F.size("gram"))
        .select("gid", "gram", F.size("gram").alias("len"), F.col("p.word").alias("word"), F.col("p.offset").alias("offset"))
    )
    keys = checkpoint(keys)
    sized, small = broadcast_if_small(keys, F.octet_length(F.concat_ws(" ", "gram")) * 2 + 128)
    start = F.col("pos") - F.col("offset")
    if small:
        probe = words.select("doc_id", "th", "ws", F.posexplode("ws").alias("pos", "word"))
        fits = (start >= 0) & (start + F.col("len") <= F.size("ws"))
        hits = probe.join(sized, "word").where(fits & F.when(fits, F.slice("ws", F.when(fits, start + 1).otherwise(1), F.col("len")) == F.col("gram")))
        return hits.select("doc_id", "th", start.alias("start"), (start + F.col("len")).alias("stop"), "gid")
    # Too many windows to broadcast: words that begin none are left out, the others fetch their windows part by part, and candidates the words of their document.
    prefixes, _ = broadcast_if_small(checkpoint(keys.select("word").distinct()), F.octet_length("word") + 64)
    key = F.struct("doc_id", "th").alias("key_")
    probe = words.select(key, F.size("ws").alias("n"), F.posexplode("ws").alias("pos", "word")).join(prefixes, "word", "left_semi")
    unit = probe.withColumn("unit_", F.hash("key_", "pos"))
    near = join_hot(unit, "word", "unit_", keys).where((start >= 0) & (start + F.col("len") <= F.col("n")))
    near = near.select("key_", start.alias("start"), "len", "gid", "gram")
    held = words.select(key, "ws").join(near.select("key_").distinct(), "key_", "left_semi").dropDuplicates(["key_"])
    hits = join_hot(near, "key_", "start", held).where(F.slice("ws", F.col("start") + 1, F.col("len")) == F.col("gram"))
    return hits.select("key_.doc_id", "key_.th", "start", (F.col("start") + F.col("len")).alias("stop"), "gid")


def _grams(bench: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Windows by item, and distinct windows with a number."""
    windows = checkpoint(item_windows(bench, window))
    return windows, checkpoint(windows.select("gram").distinct().withColumn("gid", F.monotonically_increasing_id()))


def without_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The input rows, all columns, in which no window of a benchmark item occurs.

    Null and empty texts stay; rows that repeat id and text stay or go together.
    Extra columns may have any names. An empty table stays empty, and an empty
    benchmark lets all rows stay.
    """
    hits = find_windows(docs, _grams(bench, window)[1]).select(F.struct(F.col("doc_id").cast("long"), "th").alias("key_")).distinct()
    hits, _ = broadcast_if_small(checkpoint(hits), F.lit(48))
    plain, at = by_position(docs)
    keyed = plain.withColumn("key_", F.struct(F.col(at["doc_id"]).cast("long").alias("doc_id"), F.xxhash64(at["text"]).alias("th")))
    return back(keyed.join(hits, "key_", "left_anti"), docs.columns)


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null texts have no words and no hits. Rows that repeat doc_id and text each
    get the answer of that text. Items without words match nothing; with an
    empty benchmark nothing is hit.
    """
    windows, grams = _grams(bench, window)
    hits = checkpoint(find_windows(docs, grams).distinct())
    spans = hits.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(acc["end"], s["start"]))).alias("n"), F.greatest(acc["end"], s["stop"]).alias("end")),
    )
    spans = spans.select("doc_id", "th", covered["n"].cast("long").alias("n_hit"))
    owners = windows.join(grams, "gram").select("gid", "item_id").distinct()
    owners, _ = broadcast_if_small(checkpoint(owners), F.octet_length("item_id") + 64)
    items = hits.select("doc_id", "th", "gid").distinct().join(owners, "gid").groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = spans.join(items, spans["doc_id"].eqNullSafe(items["doc_id"]) & (spans["th"] == items["th"])).select(
        spans["doc_id"].alias("d"), spans["th"].alias("t"), "n_hit", "items"
    )
    every = pick(docs, doc_id="doc_id", text="text").select("doc_id", F.xxhash64("text").alias("th"), F.size(word_array(F.col("text"))).cast("long").alias("n_words"))
    return every.join(found, every["doc_id"].eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
