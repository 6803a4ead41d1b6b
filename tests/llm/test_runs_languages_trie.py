"""Periodic runs, language ID and the conversation trie: brute force, held-out rows, and texts of all kinds."""

import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from veridock.llm import language_id as lid
from veridock.llm import periodic_runs as pr
from veridock.llm import prefix_trie as trie
from veridock.llm.queries import ORACLE, op11_periodic_runs, op12_language_id, op13_prefix_trie

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_by_hand(words):
    """Every maximal stretch of matches at every distance; the smallest period of a stretch of words counts."""
    n, out = len(words), {}
    for p in range(1, n // 3 + 1):
        x = 0
        while x + p < n:
            s = x
            while x + p < n and words[x] == words[x + p]:
                x += 1
            if x > s and x - s + p >= max(24, 3 * p):
                out.setdefault((s, x + p), p)
            x += x == s
    return sorted(((s, e, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))


def odd_words(rng, most):
    words = []
    while len(words) < most:
        if rng.random() < 0.4:
            words += [rng.choice("ab") for _ in range(rng.randint(1, 12))] * rng.randint(1, 8)
        else:
            words += [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
    return words


@pytest.mark.parametrize("points", [1 << 18, 5])
def test_runs_are_brute_force(monkeypatch, points):
    monkeypatch.setattr(pr, "POINTS", points)
    rng = random.Random(points)
    for _ in range(150):
        words = odd_words(rng, rng.randint(0, 150))
        assert [tuple(r) for r in pr.find_runs(words).tolist()] == runs_by_hand(words)


def test_grid_hits_every_stretch_once_in_chunks(monkeypatch):
    whole = [np.concatenate(c).tolist() for c in zip(*pr.grid(500), strict=True)]
    monkeypatch.setattr(pr, "POINTS", 7)
    cut = [np.concatenate(c).tolist() for c in zip(*pr.grid(500), strict=True)]
    assert sorted(zip(*whole, strict=True)) == sorted(zip(*cut, strict=True))
    assert set(zip(*whole, strict=True)) == {(p, x) for p in range(1, 167) for x in range(0, 500 - p, max(24 - p, 2 * p))}


def test_a_find_that_only_the_hash_holds_is_refused():
    ids = np.array([1, 2] * 20 + [3, 4, 5], np.int64)
    assert pr.confirmed(ids, np.array([[0, 40, 2]])) is not None
    assert pr.confirmed(ids, np.array([[0, 41, 2]])) is None
    assert pr.confirmed(ids, np.array([[0, 39, 2]])) is None
    assert pr.confirmed(ids, np.array([[0, 40, 2], [0, 40, 3]])) is None


def test_long_texts_of_one_word_are_fast():
    assert pr.find_runs(["a"] * 100_000).tolist() == [[0, 100_000, 1]]
    assert pr.collapse(["a", "b"] * 5 + ["c"], np.array([[0, 10, 2]])) == "a b c"


def expected_runs(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(words)
    gone = {k for s, e, q in runs for k in range(s + q, e)}
    best = None
    for s, e, q in runs:
        if best is None or (e - s) * best[2] > best[1] * q:
            best = (s, e - s, q)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "a b " * 30 + "  \x1c x y"),
    (4, "a b " * 30 + "  \x1c x y"),
    (None, "z " * 40),
    (None, "z " * 40),
    (5, "long text " * 20_000),
    (30, "one"),
    *[(k, " ".join(f"w{j % (k % 7 + 2)}" if k % 3 else f"w{j}" for j in range(k))) for k in range(40, 90)],
]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_runs_query_on_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    got = {(r["doc_id"], r["n_words"]): r for r in pr.periodic_runs(docs.selectExpr("*", "'x' AS runs", "1 AS Text")).collect()}
    assert got[(None, 40)]["runs"][0]["length"] == 40 and got[(None, 40)]["collapsed"] == "z"
    assert got[(5, 40_000)]["collapsed"] == "long text"
    assert got[(1, 0)]["runs"] == [] and got[(2, 0)]["collapsed"] == "" and got[(3, 0)]["runs"] == []
    assert pr.periodic_runs(docs.limit(0)).count() == 0


def test_runs_query_is_brute_force(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    rows = [r for r in ODD if r[0] != 5]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert ordered(got.collect()) == ordered(expected_runs(*r) for r in rows)


@needs_tables
def test_runs_query_on_whole_texts(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows = [r for r in rows if len(r[1] or "") < 20_000]
    got = [r for r in op11_periodic_runs(spark, SMALL).collect() if r["doc_id"] in {i for i, _ in rows}]
    assert ordered(got) == ordered(expected_runs(*r) for r in rows)


def grams_by_hand(text):
    plain = " " + re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip(" ") + " "
    return [plain[k : k + n] for n in (1, 2, 3) for k in range(len(plain) - n + 1) if plain[k : k + n] != " "]


def bucket_of(gram):
    h = 0
    for c in reversed(gram):
        h = (h * int(lid._MIX) + ord(c) + 1) % 2**64
    return ((h ^ (h >> 29)) * int(lid._MIX)) % 2**64 >> 48


@pytest.mark.parametrize("piece", [1 << 19, 5])
def test_gram_counts_and_scores_are_brute_force(monkeypatch, piece):
    monkeypatch.setattr(lid, "PIECE", piece)
    texts = ["Ab c1d", None, "", "ÉÈ ñ ñ\n12", "x" * 40, "\ud800 漢字"]
    want = [(k, bucket_of(g)) for k, t in enumerate(texts) for g in grams_by_hand(t)]
    got = [(r, b) for rows, buckets, counts in lid.sparse_counts(texts) for r, b, n in zip(rows, buckets, counts, strict=True) for _ in range(n)]
    assert sorted(got) == sorted(want)
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 9, (lid.BUCKETS, 3)).astype(float)
    model = lid.fit(["a", "b", "c"], np.array([1.0, 2.0, 3.0]), counts)
    smooth = (counts + lid.ALPHA) / (counts + lid.ALPHA).sum(0)
    best, score = model.predict(texts)
    for k, text in enumerate(texts):
        joint = [math.log((c + 1) / 6) + sum(math.log(smooth[bucket_of(g), c]) for g in grams_by_hand(text)) for c in range(3)]
        assert best[k] == int(np.argmax(joint))
        assert score[k] == pytest.approx(1 / sum(math.exp(j - max(joint)) for j in joint), rel=1e-4)


LANGS = [
    (1, "the cat and the dog", "en"),
    (2, "el perro y el gato", "es"),
    (3, "the end of the day", "en"),
    (4, None, "es"),
    (5, "", None),
    (None, "Der Hund", "de"),
    (7, "12 34 --", "en"),
    (8, "the dog", None),
    (8, "the dog", None),
    (9, "el gato " * 30_000, "es"),
]


def test_languages_on_odd_rows(spark, monkeypatch):
    plain = spark.createDataFrame(LANGS, "doc_id long, text string, lang string")
    docs = plain.selectExpr("*", "'x' AS LANG", "'y' AS score")
    got = lid.language_id(docs).collect()
    assert len(got) == len(LANGS)
    said = {}
    for r in got:
        said.setdefault(r["doc_id"], r)
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert said[8]["lang_pred"] == "en" and said[9]["lang_pred"] == "es"
    assert {said[k]["lang_pred"] for k in (4, 5, 7)} == {"und"} and said[4]["score"] == 0
    assert {r["lang_pred"] for r in got} == {"en", "es", "und"}
    assert lid.language_id(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in lid.language_id(docs.where("doc_id = 5")).collect()} == {"und"}
    assert {r["lang_pred"] for r in lid.language_id(plain.selectExpr("doc_id", "text", "CAST(NULL AS STRING) lang")).collect()} == {"und"}
    monkeypatch.setattr(lid, "MODEL_BYTES", 8 * lid.LEAST_BUCKETS * 2)
    model = lid.train(plain.where("lang <> 'de'"))
    assert model.logp.shape == (lid.LEAST_BUCKETS, 2)
    monkeypatch.setattr(lid, "MODEL_BYTES", 8 * lid.LEAST_BUCKETS)
    with pytest.raises(ValueError):
        lid.train(plain)


@needs_tables
def test_languages_of_held_out_rows(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in op12_language_id(spark, SF).collect() if r["held_out"]]
    assert len(held) > 150 and np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.98


def trie_by_hand(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn, role or "", text or ""))
    name = lambda t: hashlib.sha256(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).hexdigest()[:32]
    convs = {c: [t[1:] for t in sorted(ts, key=lambda t: (t[0] is not None, t[0] or 0, t[1], name(t)))] for c, ts in convs.items()}
    built = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = convs.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:]
    nodes, kids = {}, {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    for n in nodes:
        if n:
            kids.setdefault(n[:-1], []).append(n)
    leaves, saved = {}, {}
    for n in sorted(nodes, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids.get(n, [])) if n in kids else 1
        saved[n] = (len(nodes[n]) - 1) * (len(WORD.findall(n[-1][1])) if n else 0) + sum(saved[k] for k in kids.get(n, []))
    digest = lambda n, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(n)))).encode()).hexdigest()
    return ordered((min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), len(kids.get(n, [])), leaves[n], saved[n], digest(n, m)) for n, m in nodes.items())


def random_turns(rng, convs):
    rows = [(None, 1, "u", "t"), (None, None, None, None)]
    for c in range(convs):
        conv = rng.choice([c, c, 3 * c - 50])
        for t in range(rng.choice([1, 2, 3, 3, 6])):
            rows.append((conv, rng.choice([t, t, None]), rng.choice(["u", "u", None, "a"]), rng.choice(["x y", "x y", "b", None, "", "q\tr s"])))
    return rows


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("convs", "partitions", "piece"), [(200, 2, 1000), (200, 7, 3), (60, 40, 2), (1, 3, 5), (0, 3, 5)])
def test_trie_is_brute_force(spark, monkeypatch, convs, partitions, piece):
    monkeypatch.setattr(trie, "PIECE_IDS", piece)
    monkeypatch.setattr(trie, "OUT_ROWS", 16)
    rows = random_turns(random.Random(convs + partitions), convs)
    df = spark.createDataFrame(rows, TURNS)
    got = trie.prefix_trie(trie.spliced(trie.turn_paths(df)), partitions)
    assert ordered(got.collect()) == trie_by_hand(rows)


def test_trie_joins_open_nodes_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(trie, "broadcast_if_small", lambda df, size=None: (df, False))
    rows = random_turns(random.Random(5), 120)
    assert ordered(trie.prefix_trie(trie.spliced(trie.turn_paths(spark.createDataFrame(rows, TURNS))), 9).collect()) == trie_by_hand(rows)


def test_copies_of_a_conversation_span_partitions(spark):
    rows = [(20 * k, t, "u", f"turn {t}") for k in range(300) for t in range(4)] + [(7, 0, "u", "long " * 100_000)]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "'z' AS key", "1 AS CONV_ID_", "2 AS words")
    assert ordered(trie.prefix_trie(trie.spliced(trie.turn_paths(df)), 8).collect()) == trie_by_hand(rows)
    assert trie.conversation_trie(df.limit(0)).count() == 0
    plain = trie.conversation_trie(df, splice=False).where("depth = 0").first()
    assert plain["n_convs"] == 301 and plain["n_children"] == 2


@needs_tables
def test_trie_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.execute(ORACLE["op13_prefix_trie"]).fetchall()
    assert ordered(op13_prefix_trie(spark, SF).collect()) == ordered(want)
