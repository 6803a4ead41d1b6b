"""Near-dedup with BagMinHash signatures of word shingles.

A document is the multiset of its five-word shingles. Every (shingle, weight
level) runs a Poisson process; levels are grouped into a dyadic hierarchy, so a
shingle of weight w needs about log2(w) processes. Points fall on signature
components; each component keeps its earliest point. Two components agree with
the probability of the weighted Jaccard similarity, without bias. Processes are
advanced in rounds, only while they can still beat a document's worst component.

Signatures are cut into bands, equal bands share a bucket. A bucket's members are
verified against its most widely banded member first, which joins large groups of
copies into few components. What stands in a bucket with several components goes
on to a set join that loses nothing: two multisets of similarity 0.8 or more share
one of their rarest shingles, so only documents that share one, lie in different
components, and pass the length and positional bounds are compared. Members of a
large group that differ too much from all others have rare shingles of their own
and meet nobody. Verification is exact: overlap of the two multisets.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import map_slices
from .common import WORD, back, by_position, checkpoint, drop_table, join_groups, join_hot, pick, write_table

SHINGLE = 5
THRESHOLD = 0.8
#: A pair at the threshold shares a band with a probability of 0.9998; what shares one by chance costs little, as the set join drops it.
BANDS, ROWS = 22, 5
#: While rare shingles bring more meetings a document than this, counted once a shingle, each is tried against one document
#: per shingle first, as long as a turn joins this share of the components that meet.
OPEN_MEETINGS, OPEN_JOINED = 200, 0.05
#: Documents of one rare shingle that meet in a task.
SHARE_ROWS = 128
_WORD = re.compile(WORD)
_U = np.uint64
_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit counter-based generator (splitmix)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_hashes(words: list[str], size: int = SHINGLE) -> np.ndarray:
    """64-bit hash of every run of ``size`` words; a shorter text is one shingle, an empty one has none."""
    if not words:
        return np.zeros(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, len(h) if len(h) < size else size, _U)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(h))):
            out = _mix(out * _U(0x9E3779B97F4A7C15) + h[k : k + n])
    return out


def bag_signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """BagMinHash of (distinct hashes, integer weights) bags: len(bags) x m component values; all 0 for an empty bag."""
    sig = np.zeros((len(bags), m), _U)
    best = np.full(len(bags) * m, np.inf)
    mark = np.zeros(len(bags) * m, _U)
    doc = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    if not len(doc):
        return sig
    hashes, weights = np.concatenate([h for h, _ in bags]), np.concatenate([w for _, w in bags]).astype(np.int64)
    with np.errstate(over="ignore"):
        # Process j covers the levels of (2^(j-1), 2^j], process 0 the first level.
        states, docs, low, span, top = [], [], [], [], []
        j = 0
        while True:
            base, width = (0, 1) if j == 0 else (1 << (j - 1), 1 << (j - 1))
            on = weights > base
            if not on.any():
                break
            states.append(_mix(hashes[on] + _U(0x9E3779B97F4A7C15) * _U(j + 1)))
            docs.append(doc[on])
            low.append(np.full(on.sum(), base))
            span.append(np.full(on.sum(), width))
            top.append(weights[on])
            j += 1
        state, d, base, width, w = map(np.concatenate, (states, docs, low, span, top))
        time = np.zeros(len(state))
        while len(state):
            a, b = _mix(state + _U(1)), _mix(state + _U(2))
            time = time - np.log1p(-(a >> _U(11)).astype(np.float64) * 2.0**-53) / (width * m)
            slot = d * m + ((b >> _U(32)) % _U(m)).astype(np.int64)
            level = base + ((b & _U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * width).astype(np.int64)
            # A point above the shingle's weight belongs to a level that this document lacks.
            live = (level < w) & (time < best[slot])
            order = np.flatnonzero(live)
            if len(order):
                order = order[np.argsort(-time[order], kind="stable")]
                best[slot[order]] = time[order]
                mark[slot[order]] = _mix(a[order] ^ b[order])
            worst = best.reshape(-1, m).max(1)
            on = time < worst[d]
            state, d, base, width, w, time = _mix(state[on] + _U(3)), d[on], base[on], width[on], w[on], time[on]
    return mark.reshape(-1, m)


def _bag(text: str | None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    words = _WORD.findall((text or "").translate(_ASCII_LOWER))
    return (*np.unique(shingle_hashes(words), return_counts=True), words)


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """row, doc_id, th, body (digest of the word sequence), n (shingles), buckets (one per band: a hash of band number and components)."""

    def run(row, ids, ths, texts):
        bags, bodies = [], []
        for text in texts:
            h, w, words = _bag(text)
            bags.append((h, w))
            bodies.append(xxhash.xxh3_128_digest(" ".join(words)))
        sig = bag_signatures(bags, bands * rows)
        with np.errstate(over="ignore"):
            keys = np.tile(np.arange(1, bands + 1, dtype=_U), (len(bags), 1))
            for k in range(rows):
                keys = _mix(keys * _U(0x9E3779B97F4A7C15) + sig[:, k::rows])
        return [row, ids, ths, bodies, [int(w.sum()) for _, w in bags], list(keys.view(np.int64))]

    return map_slices(docs.select("row", "doc_id", "th", "text"), run, "row long, doc_id long, th long, body binary, n long, buckets array<long>")


def fitting(threshold: float):
    """Two sizes na and nb that allow the threshold."""
    return F.least("na", "nb") >= threshold * F.greatest("na", "nb")


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose shingle multisets have weighted Jaccard similarity of at least ``threshold``."""
    one, two = texts.select(F.col("row").alias("a"), F.col("text").alias("ta")), texts.select(F.col("row").alias("b"), F.col("text").alias("tb"))
    # Both sides of these joins come straight from a shuffle, so adaptive execution splits a hub that many pairs share.
    joined = pairs.select("a", "b").join(two.hint("merge"), "b").join(one.hint("merge"), "a").select("a", "b", "ta", "tb")

    def run(a, b, ta, tb):
        memo: dict[int, tuple] = {}
        out = [[], [], []]
        for i, j, x, y in zip(a, b, ta, tb, strict=True):
            for key, text in ((i, x), (j, y)):
                if key not in memo:
                    if len(memo) > 512:
                        memo.clear()
                    memo[key] = _bag(text)[:2]
            (hx, wx), (hy, wy) = memo.get(i) or _bag(x)[:2], memo.get(j) or _bag(y)[:2]
            _, kx, ky = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
            both = int(np.minimum(wx[kx], wy[ky]).sum())
            similarity = both / (int(wx.sum()) + int(wy.sum()) - both)
            if similarity >= threshold:
                for col, v in zip(out, (i, j, similarity), strict=True):
                    col.append(v)
        return out

    return map_slices(joined, run, "a long, b long, similarity double", rows=128)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """row, comp: smallest row of each connected component, by alternating large-star and small-star steps."""
    edges = checkpoint(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct())
    before = None
    while True:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        near = join_groups(both, ["u"], "v", [F.min("v").alias("m")], [F.min("m").alias("m")])
        large = near.where("v > u").select(F.least("m", "u").alias("u"), "v")
        least = large.groupBy("v").agg(F.min("u").alias("p"))
        ends = F.explode(F.array(F.struct(F.col("p").alias("u"), "v"), F.struct(F.col("p").alias("u"), F.col("u").alias("v"))))
        edges = checkpoint(large.join(least, "v").select(ends.alias("e")).select("e.*").where("u < v").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    parents = edges.groupBy("v").agg(F.min("u").alias("p"))
    return nodes.join(parents, nodes["row"] == parents["v"], "left").select("row", F.coalesce("p", "row").alias("comp"))


def joined_classes(comp: DataFrame, links: DataFrame) -> DataFrame:
    """row, comp after further links: components of the graph whose nodes are the components so far."""
    ends = [comp.select(F.col("row").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab"]
    edges = links.select("a", "b").join(ends[1].hint("merge"), "b").join(ends[0].hint("merge"), "a").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    names = components(comp.select(F.col("comp").alias("row")).distinct(), edges).select(F.col("comp").alias("joined"), F.col("row").alias("comp"))
    return join_hot(comp, "comp", "row", names).select("row", F.col("joined").alias("comp"))


def rare_postings(texts: DataFrame, threshold: float) -> DataFrame:
    """row, n, h, pos: the shared shingles among a document's rarest, as many as any partner must share one of.

    Shingles are ordered by the number of these documents that have them, then by
    hash. Of n shingles, counted with repeats, the first n - ceil(threshold * n) + 1
    are needed; pos is the number before this one.
    """

    def run(rows, texts):
        bags = [_bag(t)[:2] for t in texts]
        return [rows, [int(w.sum()) for _, w in bags], [[{"h": int(x), "w": int(k)} for x, k in zip(h.view(np.int64), w, strict=True)] for h, w in bags]]

    bags = map_slices(texts.select("row", "text"), run, "row long, n long, bag array<struct<h:long,w:int>>", rows=64)
    tokens = bags.select("row", "n", F.explode("bag").alias("t")).select("row", "n", "t.h", "t.w")
    ranked = join_groups(tokens, ["h"], "row", [F.count(F.lit(1)).alias("df")], [F.sum("df").alias("df")])
    upto = F.sum("w").over(Window.partitionBy("row").orderBy("df", "h").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranked.withColumn("pos", upto - F.col("w"))
    return placed.where((F.col("pos") < F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-6) + 1) & (F.col("df") > 1)).select("row", "n", "h", "pos")


def open_shingles(postings: DataFrame, comp: DataFrame) -> DataFrame:
    """row, n, h, pos, comp, major, total, outside: postings of the shingles that several components share.

    major is the component with most documents of the shingle, total the number of
    its documents, outside that of those in other components.
    """
    placed = postings.join(comp, "row")
    sizes = placed.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("h")
    groups = sizes.agg(F.max(F.struct("k", "comp")).alias("m"), F.sum("k").alias("total"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return join_hot(placed, "h", "row", groups.select("h", F.col("m.comp").alias("major"), "total", (F.col("total") - F.col("m.k")).alias("outside")))


def open_pairs(shared: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different components that share a rare shingle and pass the length and positional bounds.

    Documents outside a shingle's major component meet all others. Both sides are
    dealt into shares, so a task compares at most about ``SHARE_ROWS`` squared of
    them, none of the major component's own pairs is ever formed, and only lengths
    of one or of neighbouring classes meet: a class spans the ratio ``threshold``.
    """
    rows, of_left, of_right = F.xxhash64("row"), F.ceil(F.col("outside") / SHARE_ROWS).cast("int"), F.ceil(F.col("total") / SHARE_ROWS).cast("int")
    length = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(threshold)) + 1e-9).cast("int")
    right = shared.select("h", "major", F.col("row").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("comp").alias("cb"), length.alias("length"), F.pmod(rows, of_right).cast("int").alias("rs"))
    left = shared.where("comp <> major").select("h", F.col("row").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("comp").alias("ca"), length.alias("l"), F.pmod(rows, of_left).cast("int").alias("ls"), F.sequence(F.lit(0), of_right - 1).alias("rss"))
    left = left.withColumn("length", F.explode(F.array(F.col("l") - 1, F.col("l"), F.col("l") + 1)))
    # A row goes to the shares of the other side, on the right to those that have rows of its class.
    waiting = left.groupBy("h", "length").agg(F.collect_set("ls").alias("lss"))
    right = join_hot(right, ["h", "length"], "b", waiting).withColumn("ls", F.explode("lss")).drop("lss")
    left = left.withColumn("rs", F.explode("rss")).drop("rss", "l")
    once = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("major")) | (F.col("a") < F.col("b")))
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-6)
    able = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need
    found = left.join(right, ["h", "length", "ls", "rs"]).where(once & fitting(threshold) & able)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def hub_pairs(shared: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each open shingle's documents with one of its major component, another at every turn."""
    order = F.struct(F.xxhash64("row", F.lit(turn)).alias("o"), "row")
    hubs = shared.where("comp = major").groupBy("h").agg(F.max(order).alias("hub")).select("h", F.col("hub.row").alias("b"))
    pairs = join_hot(shared.where("comp <> major").select("h", F.col("row").alias("a")), "h", "a", hubs)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, th (hash of the text), class_id, class_size, kept: one row per input row.

    class_id is the smallest doc_id of the class.

    Classes are the connected components of links: equal word sequences, or
    weighted Jaccard similarity of five-word shingles of at least ``threshold``.
    Kept is the first row of a class by doc_id (null ids last; of rows that
    repeat an id, one). Texts without words, null ones too, are equal to each
    other. A text of fewer than five words is one shingle. An empty table gives
    an empty result.
    """
    table = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    # Names hold because they are written before anything uses them.
    sigs = write_table(signatures(table.withColumn("row", F.monotonically_increasing_id()), bands, rows), "near_sigs")
    member = join_groups(sigs.select("row", "doc_id", "th", "body"), ["body"], "row", [F.min("row").alias("rep")], [F.min("rep").alias("rep")])
    member = write_table(member.select("row", "doc_id", "th", "rep"), "near_same")
    reps = sigs.join(member.where("row = rep").select("row"), "row", "left_semi")
    flat = reps.where("n > 0").select("row", F.explode("buckets").alias("bucket"))
    inside = write_table(join_groups(flat, ["bucket"], "row", [F.count(F.lit(1)).alias("k")], [F.sum("k").alias("k")], "k > 1"), "near_buckets")
    reach = checkpoint(inside.groupBy("row").agg(F.sum("k").alias("reach")))
    where = reach.join(sigs, "row").select("row", F.col("doc_id").alias("d"), F.col("th").alias("t"))
    texts = table.join(where, table["doc_id"].eqNullSafe(where["d"]) & (table["th"] == where["t"])).select("row", "text").dropDuplicates(["row"])
    texts = write_table(texts, "near_texts")
    # A bucket's hub is its member with most company over all bands: the middle of a group, and the same one in most of its buckets.
    best = F.max(F.struct("reach", (-F.col("row")).alias("r"))).alias("hub")
    hubs = join_groups(inside.join(reach, "row"), ["bucket"], "row", [best], [F.max("hub").alias("hub")])
    drop_table(sigs)
    first = write_table(hubs.select(F.col("row").alias("a"), (-F.col("hub.r")).alias("b")).where("a <> b").distinct(), "near_pairs")
    links = write_table(verify(first, texts, threshold), "near_links")
    comp = checkpoint(components(reach.select("row"), links))
    mixed = join_groups(inside.join(comp, "row"), ["bucket"], "row", [F.min("comp").alias("lo"), F.max("comp").alias("hi")], [F.min("lo").alias("lo"), F.max("hi").alias("hi")], "lo < hi")
    postings = write_table(rare_postings(texts.join(mixed.select("row").distinct(), "row", "left_semi"), threshold), "near_postings")
    drop_table(inside, first)
    turn, before = 0, None
    while True:
        shared = write_table(open_shingles(postings, comp), "near_open")
        documents, parts, meetings = shared.agg(F.count_distinct("row"), F.count_distinct("comp"), F.sum(F.when(F.col("comp") != F.col("major"), F.col("total")))).first()
        if (meetings or 0) <= OPEN_MEETINGS * documents or before is not None and parts > before * (1 - OPEN_JOINED):
            break
        hub_links = write_table(verify(hub_pairs(shared, turn), texts, threshold), "near_hub_links")
        comp = checkpoint(joined_classes(comp, hub_links))
        drop_table(shared, hub_links)
        turn, before = turn + 1, parts
    rest = write_table(open_pairs(shared, threshold), "near_rest")
    more = write_table(verify(rest, texts, threshold), "near_more")
    comp = checkpoint(joined_classes(comp, more))
    drop_table(postings, shared, rest, more, texts, links)
    classed = join_hot(member, "rep", "row", comp.withColumnRenamed("row", "rep"), "left").select("doc_id", "th", "row", F.coalesce("comp", "rep").alias("comp"))
    first_row = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row")
    classed = join_groups(write_table(classed, "near_classes"), ["comp"], "row", [F.min(first_row).alias("k"), F.count(F.lit(1)).alias("class_size")], [F.min("k").alias("k"), F.sum("class_size").alias("class_size")])
    return classed.select("doc_id", "th", F.col("k.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("k.row")).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, class_id, class_size, kept (see near_classes)."""
    return near_classes(docs).drop("th")


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """The input rows, all columns, that stay when one document of each class does.

    See near_classes for nulls, empty texts and ties; rows that repeat id and
    text are one document, of which one row stays. Extra columns may have any
    names. An empty table stays empty.
    """
    plain, at = by_position(docs)
    keep = near_classes(docs).where("kept").select(F.struct("doc_id", "th").alias("key_"))
    keyed = plain.withColumn("key_", F.struct(F.col(at["doc_id"]).cast("long").alias("doc_id"), F.xxhash64(at["text"]).alias("th")))
    return back(keyed.join(keep, "key_", "left_semi").dropDuplicates(["key_"]), docs.columns)
