"""Line dedup, near dedup and the pipeline against brute force, with edge cases."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridock.llm import near_dup
from veridock.llm.common import WORD
from veridock.llm.line_dedup import cut_repeated_runs, line_dedup, window_minima, winnow
from veridock.llm.near_dup import bag_signatures, near_classes, near_duplicates, one_of_each_class

SF = "/root/testdata/sf0.001"


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def sentence(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def brute_line_dedup(docs, min_words):
    """Text that stays: a line goes if it lies in a window of min_words words that stands earlier in the corpus."""
    order = sorted(range(len(docs)), key=lambda k: docs[k][0])
    split = [t.split("\n") for _, t in docs]
    seen, out = {}, {}
    for k in order:
        lines, gone = split[k], set()
        counts = [len(x.split()) for x in lines]
        for at in range(len(lines)):
            if not counts[at]:
                continue
            end, words = at, 0
            while end < len(lines) and words < min_words:
                words += counts[end]
                end += 1
            if words >= min_words:
                body = tuple(lines[at:end])
                if body in seen:
                    src, s = seen[body]
                    lo, hi = 0, end - at
                    while at + lo > 0 and s + lo > 0 and lines[at + lo - 1] == split[src][s + lo - 1]:
                        lo -= 1
                    while at + hi < len(lines) and s + hi < len(split[src]) and lines[at + hi] == split[src][s + hi]:
                        hi += 1
                    gone |= set(range(at + lo, at + hi))
                else:
                    seen[body] = (k, at)
        out[docs[k][0]] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_line_dedup_is_brute_force(spark):
    rng = random.Random(3)
    lines = [sentence(rng, rng.randrange(1, 9)) for _ in range(400)]
    blocks = [[rng.choice(lines) for _ in range(rng.randrange(4, 9))] for _ in range(8)]
    docs = []
    for k in range(60):
        text = []
        for _ in range(rng.randrange(1, 5)):
            text += rng.choice(blocks) if rng.random() < 0.4 else [sentence(rng, 6, 10**9) for _ in range(4)]
        docs.append((k, "\n".join(text)))
    got = {r.doc_id: r.text for r in line_dedup(table(spark, docs), 20).collect()}
    assert got == brute_line_dedup(docs, 20)
    assert any(got[k] != t for k, t in docs)


def test_fingerprints_are_guaranteed_and_selected():
    """Whatever repeats with min_words words or more shares a selected gram, wherever it stands; not every window adds one."""
    rng = random.Random(1)
    selected = windows = 0
    for _ in range(300):
        shared = [(rng.getrandbits(40), rng.randrange(0, 5)) for _ in range(rng.randrange(2, 12))]
        around = [[(rng.getrandbits(40), rng.randrange(1, 5)) for _ in range(rng.randrange(0, 6))] for _ in range(4)]
        one, two = around[0] + shared + around[1], around[2] + shared + around[3]
        prints = []
        for d in (one, two):
            h, n = [x for x, _ in d], [x for _, x in d]
            prints.append({g for g, _, _, _ in winnow(h, n, 16)})
            selected, windows = selected + len(prints[-1]), windows + len(window_minima(h, n, 16))
        if sum(n for _, n in shared) >= 16 and shared[0][1]:
            assert prints[0] & prints[1]
    assert selected < 0.7 * windows


def test_text_whose_fingerprint_stood_elsewhere_first(spark):
    """The first place of a shared boilerplate isn't the first place of what surrounds it."""
    rng = random.Random(8)
    plate = [sentence(rng, 6) for _ in range(3)]
    docs = []
    for k in range(40):
        around = [sentence(random.Random(k // 2), 5, 10**9), *plate, sentence(random.Random(k // 2 + 100), 5, 10**9)]
        docs.append((k, "\n".join([f"own {k}", *around, f"end {k}"])))
    got = {r.doc_id: r.text for r in line_dedup(table(spark, docs), 24).collect()}
    assert got == brute_line_dedup(docs, 24)
    assert all((got[k] == t) == (k % 2 == 0) for k, t in docs)


PASSAGE = "\n".join(f"line {k} of a passage that many documents share word for word" for k in range(8))


def test_line_dedup_edges(spark):
    rows = [(1, f"start\n{PASSAGE}\nend"), (2, f"other\n{PASSAGE}"), (3, PASSAGE), (3, PASSAGE), (4, None), (5, ""), (6, "\n\n\n"), (None, PASSAGE), (7, f"{PASSAGE}\nbetween\n{PASSAGE}"), (8, "line 0 of a passage that many documents share word for word")]
    got = line_dedup(table(spark, rows).selectExpr("doc_id", "text", "1 n_lines", "'x' th")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    # Null ids come first, so the passage stays there alone.
    assert by[None].text == PASSAGE and by[None].n_removed == 0
    assert by[1].text == "start\nend" and by[2].text == "other" and by[3].text == "" and by[7].text == "between"
    assert by[4].text is None and by[4].n_lines == 0 and by[5].text == "" and by[6].text == "\n\n\n" and by[8].text == rows[-1][1]
    assert line_dedup(table(spark, [])).count() == 0
    kept = cut_repeated_runs(table(spark, [(1, PASSAGE, 7), (2, PASSAGE, 7)], "doc_id long, text string, n_chars long")).collect()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in kept) == [(1, PASSAGE, 7), (2, "", 0)]


def bag(text):
    ws = re.findall(WORD, (text or "").lower())
    return Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else Counter()


def brute_classes(docs, threshold=0.8):
    bags, parent = [bag(t) for _, t in docs], list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(docs)):
        for j in range(i):
            both, either = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if (not either) or both / either >= threshold:
                parent[root(i)] = root(j)
    groups = {}
    for k in range(len(docs)):
        groups.setdefault(root(k), []).append(docs[k][0])
    return sorted(sorted(map(repr, g)) for g in groups.values())


def near_rows():
    rng = random.Random(11)
    docs, doc_id = [], 0
    for _ in range(25):
        words = sentence(rng, rng.randrange(60, 300)).split()
        for edits in (0, 0, 1, 2, 3, 9, 30):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            docs.append((doc_id, " ".join(copy)))
            doc_id += 1
    docs += [(1000, None), (1001, ""), (1002, "!?"), (1003, "a b"), (1004, "A  b."), (None, "a b c d"), (1005, "la " * 300), (1006, "la " * 301), (1007, "la " * 500)]
    return docs


def test_near_duplicates_are_brute_force(spark):
    docs = near_rows()
    got = near_duplicates(table(spark, docs).selectExpr("doc_id", "text", "0 class_id", "1 row")).collect()
    assert len(got) == len(docs)
    groups = {}
    for r in got:
        groups.setdefault(r.class_id, []).append(repr(r.doc_id))
    assert sorted(sorted(g) for g in groups.values()) == brute_classes(docs)
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.class_size == len(groups[r.class_id]) for r in got)


def test_near_dedup_edges(spark):
    assert near_duplicates(table(spark, [])).count() == 0
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "other text")]
    left = one_of_each_class(table(spark, rows).selectExpr("doc_id", "text", "'s' source"))
    assert left.columns == ["doc_id", "text", "source"] and sorted(r.doc_id for r in left.collect()) == [1, 2]


def test_a_large_group_of_near_copies_stays_cheap(spark, monkeypatch):
    """Copies of one text, half of them edited too much: the pairs that are verified grow with the group, not with its square."""
    rng = random.Random(5)
    words = sentence(rng, 200).split()
    docs = []
    for k in range(300):
        copy = list(words)
        for e in range(1 if k % 2 else 14):
            copy[rng.randrange(200)] = f"own{k}x{e}"
        docs.append((k, " ".join(copy)))
    seen, real = [], near_dup.verify

    def counted(pairs, texts, threshold):
        seen.append(pairs.count())
        return real(pairs, texts, threshold)

    monkeypatch.setattr(near_dup, "verify", counted)
    got = near_duplicates(table(spark, docs)).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.class_id, []).append(repr(r.doc_id))
    assert sorted(sorted(g) for g in groups.values()) == brute_classes(docs)
    assert max(map(len, groups.values())) >= 150
    assert sum(seen) < 20 * len(docs) < 300 * 299 / 2


def test_signatures_estimate_weighted_jaccard_without_bias():
    rng = np.random.default_rng(2)
    hashes = rng.integers(1, 2**63, 60).astype(np.uint64)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    sig = bag_signatures([(hashes[a > 0], a[a > 0]), (hashes[b > 0], b[b > 0])], 8192)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03
    assert (bag_signatures([(hashes[:0], a[:0])], 16) == 0).all()


def test_bands_reach_the_threshold():
    """The chance that a pair at the threshold shares no band is below a tenth of a percent."""
    assert (1 - near_dup.THRESHOLD**near_dup.ROWS) ** near_dup.BANDS < 1e-3


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "tokenization"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, now = [docs.count()], docs
    for _, stage in p.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
        now = spark.createDataFrame(now.collect(), docs.schema)
        sizes.append(now.count())
    assert sizes[2] == sizes[1] and sizes[3] < sizes[2] and sizes[4] < sizes[3]
    rows = p.run(spark, SF).select("doc_id", "n_tokens", "round_trip").collect()
    assert len(rows) == sizes[-1] and all(r.round_trip for r in rows)


def test_open_pairs_are_all_pairs_that_the_bounds_allow(spark, monkeypatch):
    """Both sides in many shares: every pair of different components once, none that the bounds exclude."""
    monkeypatch.setattr(near_dup, "SHARE_ROWS", 4)
    rng = random.Random(4)
    rows = [(h, r, rng.randint(5, 60), rng.randint(0, 3), rng.choice([1, 1, 1, r]), 1) for h in (1, 2) for r in range(100, 160)]
    table = spark.createDataFrame(rows, "h long, row long, n long, pos long, comp long, major long")
    sizes = table.groupBy("h").agg(F.count("*").alias("total"), F.sum((F.col("comp") != 1).cast("long")).alias("outside"))
    got = sorted(tuple(r) for r in near_dup.open_pairs(table.join(sizes, "h"), 0.8).collect())
    want = set()
    for h, a, na, pa, ca, _ in rows:
        for h2, b, nb, pb, cb, _ in rows:
            if h == h2 and a < b and ca != cb and min(na, nb) >= 0.8 * max(na, nb) and min(na - pa, nb - pb) >= math.ceil(0.8 / 1.8 * (na + nb) - 1e-6):
                want.add((a, b))
    assert got == sorted(want) and len(got) > 50


def test_many_components_with_one_common_passage(spark):
    """Documents that share a passage and are else their own meet nobody: their own shingles are rarer."""
    words = [f"c{k}" for k in range(12)]
    rows = [(k, " ".join(words + [f"d{k}x{j}" for j in range(8)])) for k in range(600)]
    rows += [(1000 + k, " ".join([*words, *[f"e{k // 2}x{j}" for j in range(60)], f"t{k}"])) for k in range(40)]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == k for k in range(600))
    assert all(got[1000 + k] == 1000 + k - k % 2 for k in range(40))
