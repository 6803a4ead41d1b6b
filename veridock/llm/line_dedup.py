"""Line dedup by winnowing over line hashes.

A gram is the shortest stretch of lines, from a given line on, that has a quarter
of ``min_words`` words; a window the shortest one that has ``min_words``. Of the
grams within a window the one of smallest hash is selected, and a selected gram is
a fingerprint once, however many windows select it. Whatever repeats with min_words
words or more holds a whole window, so both copies share a fingerprint.

Fingerprints are joined to their first position in the corpus, and the match is
extended line by line both ways. A run of min_words words or more is deleted. Where
the run doesn't reach over all windows that selected the fingerprint, the first
position may not be where the text stood first; for such fingerprints the windows
themselves are joined to their first positions, and these matches extended too.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_slices
from .common import back, by_position, checkpoint, drop_table, join_groups, join_hot, pick, write_table

MIN_WORDS = 50
_DOC = "doc struct<doc_id:long,th:long>"


def line_table(docs: DataFrame) -> DataFrame:
    """doc, hs, counts: hash and number of words of every line of a text."""

    def run(doc, texts):
        hs, counts = [], []
        for text in texts:
            lines = text.split("\n")
            hs.append(np.array([xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) for line in lines], "<u8").view("<i8"))
            counts.append([len(line.split()) for line in lines])
        return [doc, hs, counts]

    return map_slices(docs.select("doc", "text"), run, f"{_DOC}, hs array<long>, counts array<int>")


def stretches(counts: list[int], words: int) -> list[tuple[int, int]]:
    """(first, last) line of the shortest stretch of ``words`` words from every line with words on, where there is one."""
    out, end, have = [], 0, 0
    for at in range(len(counts)):
        while end < len(counts) and have < words:
            have += counts[end]
            end += 1
        if have < words:
            break
        if counts[at]:
            out.append((at, end - 1))
        have -= counts[at]
    return out


def window_minima(hashes: list[int], counts: list[int], min_words: int) -> list[tuple[int, int, int, int]]:
    """(gram hash, gram's first line, first line, last line of the window) of every window: its smallest gram, the last of equals."""
    packed = np.array(hashes, "<i8")
    grams = [(xxhash.xxh3_64_intdigest(packed[a : b + 1].tobytes()) - (1 << 63), a, b) for a, b in stretches(counts, max(1, min_words // 4))]
    out, queue, head, nxt = [], [], 0, 0
    for first, last in stretches(counts, min_words):
        # Grams that end in the window, in a queue whose hashes rise: its head is the smallest.
        while nxt < len(grams) and grams[nxt][2] <= last:
            while len(queue) > head and queue[-1][0] >= grams[nxt][0]:
                queue.pop()
            queue.append(grams[nxt])
            nxt += 1
        while queue[head][1] < first:
            head += 1
        out.append((queue[head][0], queue[head][1], first, last))
    return out


def winnow(hashes: list[int], counts: list[int], min_words: int) -> list[tuple[int, int, int, int]]:
    """(gram hash, line, first, last) of every selected gram, once; first and last line of all windows that select it."""
    out: list[tuple[int, int, int, int]] = []
    for gram, at, first, last in window_minima(hashes, counts, min_words):
        if out and out[-1][1] == at:
            out[-1] = (gram, at, out[-1][2], last)
        else:
            out.append((gram, at, first, last))
    return out


def fingerprints(lines: DataFrame, min_words: int) -> DataFrame:
    """doc, print, at, first, last of every selected gram; prev: the line where the document had it last before, else null."""

    def run(docs, hs, counts):
        cols: list[list] = [[] for _ in range(6)]
        for doc, h, n in zip(docs, hs, counts, strict=True):
            seen: dict[int, int] = {}
            for gram, at, first, last in winnow(h, n, min_words):
                for col, v in zip(cols, (doc, gram, at, first, last, seen.get(gram)), strict=True):
                    col.append(v)
                seen[gram] = at
        return cols

    return map_slices(lines, run, f"{_DOC}, print long, at int, first int, last int, prev int")


def window_bodies(lines: DataFrame, ranges: DataFrame, min_words: int) -> DataFrame:
    """doc, print (content hash of a window), at, first, last, prev: the windows inside the given line ranges of each document."""

    def run(docs, hs, counts, ranges):
        cols: list[list] = [[] for _ in range(6)]
        for doc, h, n, wanted in zip(docs, hs, counts, ranges, strict=True):
            packed, seen, inside = np.array(h, "<i8"), {}, {(r["first"], r["at"]): r["last"] for r in wanted}
            # A window belongs to the range of the gram it selects.
            by_gram = {at: (first, last) for (first, at), last in inside.items()}
            for _, gram_at, first, last in window_minima(h, n, min_words):
                lo, hi = by_gram.get(gram_at, (1, 0))
                if lo <= first and last <= hi:
                    body = xxhash.xxh3_128_digest(packed[first : last + 1].tobytes())
                    for col, v in zip(cols, (doc, body, first, first, last, seen.get(body)), strict=True):
                        col.append(v)
                    seen[body] = first
        return cols

    return map_slices(join_hot(lines, "doc", "doc", ranges), run, f"{_DOC}, print binary, at int, first int, last int, prev int", rows=64)


def matches(prints: DataFrame) -> DataFrame:
    """doc, src, shift, spans: each print's line in ``doc`` and shift to its first place in the corpus or its last place in the document.

    Prints on one alignment of two documents are one row.
    """
    place = F.struct("doc", "at")
    # A document joins the corpus' first place once per print; its further places join its own last one.
    fresh = prints.where("prev IS NULL")
    across = join_groups(fresh, ["print"], "doc", [F.min(place).alias("src"), F.count(F.lit(1)).alias("n")], [F.min("src").alias("src"), F.sum("n").alias("n")], "n > 1")
    across = across.where(F.col("doc") > F.col("src.doc")).withColumn("shift", F.col("src.at") - F.col("at")).withColumn("src", F.col("src.doc"))
    within = prints.where("prev IS NOT NULL").withColumn("src", F.col("doc")).withColumn("shift", F.col("prev") - F.col("at"))
    columns = ["doc", "src", "shift", "print", "at", "first", "last"]
    span = F.array_sort(F.collect_set(F.struct("at", "first", "last", "print"))).alias("spans")
    return across.select(*columns).unionByName(within.select(*columns)).groupBy("doc", "src", "shift").agg(span)


def extend(hs: list[int], src: list[int], offset: int, shift: int, at: list[int]) -> list[tuple[int, int] | None]:
    """Around each given line the line range over which line i equals line i + shift of the source, whose lines are given from ``offset`` on."""
    lo, hi = max(0, offset - shift), min(len(hs), offset + len(src) - shift)
    equal = np.array(hs[lo:hi]) == np.array(src[lo + shift - offset : hi + shift - offset])
    breaks = np.flatnonzero(~equal) + lo
    out = []
    for line in at:
        k = int(np.searchsorted(breaks, line))
        if not lo <= line < hi or k < len(breaks) and breaks[k] == line:
            out.append(None)
        else:
            out.append((int(breaks[k - 1]) + 1 if k else lo, int(breaks[k]) - 1 if k < len(breaks) else hi - 1))
    return out


def extended(found: DataFrame, lines: DataFrame, min_words: int, kind: str) -> DataFrame:
    """doc, runs (line ranges of min_words words or more that repeat the source), open (prints whose run leaves a window out)."""
    both = join_hot(found, "doc", "src", lines)
    source = lines.select(F.col("doc").alias("src"), F.col("hs").alias("src_hs"))
    # Of the source only the lines that the document can cover travel on.
    offset = F.greatest(F.lit(0), F.col("shift"))
    both = join_hot(both, "src", "doc", source).select("doc", "shift", "spans", "hs", "counts", F.slice("src_hs", offset + 1, F.size("hs")).alias("src_hs"))

    def run(docs, shifts, spans, hs, counts, src_hs):
        runs, left = [], []
        for shift, ranges, a, n, b in zip(shifts, spans, hs, counts, src_hs, strict=True):
            words = np.concatenate([[0], np.cumsum(n)])
            good, short = set(), set()
            for r, got in zip(ranges, extend(a, b, max(0, shift), shift, [r["at"] for r in ranges]), strict=True):
                if got and words[got[1] + 1] - words[got[0]] >= min_words:
                    good.add(got)
                if not got or got[0] > r["first"] or got[1] < r["last"]:
                    short.add(r["print"])
            runs.append([{"first": f, "last": t} for f, t in sorted(good)])
            left.append(sorted(short))
        return [docs, runs, left]

    return map_slices(both, run, f"{_DOC}, runs array<struct<first:int,last:int>>, open array<{kind}>", rows=64)


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, runs: sorted (first, last) line ranges of each document that repeat earlier text.

    Earlier means a smaller doc_id (null first), then the text hash, then the
    line. ``docs`` has doc (doc_id and th, the text's hash) and text without nulls
    in text. Rows of one doc are one document.
    """
    every = write_table(line_table(docs), "lines")
    lines = every.dropDuplicates(["doc"])
    prints = write_table(fingerprints(every, min_words), "line_prints")
    first = write_table(extended(matches(prints), lines, min_words, "long"), "line_runs")
    left = first.select(F.explode("open").alias("print")).distinct()
    ranges = join_hot(prints, "print", "doc", left).groupBy("doc").agg(F.collect_set(F.struct("first", "at", "last")).alias("ranges"))
    bodies = checkpoint(window_bodies(lines, ranges, min_words))
    second = extended(matches(bodies), lines, min_words, "binary")
    runs = first.select("doc", "runs").unionByName(second.select("doc", "runs"))
    runs = checkpoint(runs.select("doc", F.explode("runs").alias("r")).groupBy("doc").agg(F.array_sort(F.collect_set("r")).alias("runs")))
    drop_table(every, prints, first)
    return runs


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per input row: doc_id, text (what stays), n_lines, n_removed.

    Null texts stay null, empty ones empty; they have one line without words.
    Runs below min_words words stay. The first copy of a run stays whole; a text
    that repeats earlier ones altogether becomes empty. Rows that repeat doc_id
    and text are one document and keep the same lines.
    """
    doc = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"))
    rows = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), "text", doc.alias("doc"))
    runs = repeated_runs(rows.where("text IS NOT NULL"), min_words)
    return rows.join(runs, "doc", "left").select("doc_id", *without_runs(F.col("text"), F.col("runs")))


def without_runs(text, runs):
    """Columns text, n_lines and n_removed after the given line ranges are cut."""
    lines = F.split(text, "\n", -1)
    kept = F.when(runs.isNull(), lines).otherwise(F.filter(lines, lambda x, i: ~F.exists(runs, lambda r: (r["first"] <= i) & (i <= r["last"]))))
    n = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    return [
        F.when(runs.isNull(), text).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.when(text.isNull(), F.lit(0)).otherwise(n).cast("long").alias("n_lines"),
        F.when(text.isNull() | runs.isNull(), F.lit(0)).otherwise(n - F.size(kept)).cast("long").alias("n_removed"),
    ]


def cut_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The input rows and columns with repeated runs cut from text, and n_chars, where there is one, to match.

    See line_dedup for nulls, empty texts, ties and repeated rows. Extra columns
    may have any names. An empty table stays empty.
    """
    plain, at = by_position(docs)
    doc = F.struct(F.col(at["doc_id"]).cast("long").alias("doc_id"), F.xxhash64(at["text"]).alias("th"))
    keyed = plain.withColumn("doc", doc)
    runs = repeated_runs(keyed.select("doc", F.col(at["text"]).alias("text")).where("text IS NOT NULL"), min_words)
    joined = keyed.join(runs, "doc", "left")
    text = without_runs(F.col(at["text"]), F.col("runs"))[0]
    if "n_chars" in at:
        length = F.when(F.col("runs").isNull(), F.col(at["n_chars"])).otherwise(F.length(text)).cast("long")
        joined = joined.withColumn("length_", length)
    made = joined.withColumn(at["text"], text)
    return back(made.withColumn(at["n_chars"], F.col("length_")) if "n_chars" in at else made, docs.columns)
