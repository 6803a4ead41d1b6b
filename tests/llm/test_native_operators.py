"""Exact dedup, decontamination and license scans against brute force, with edge cases."""

import hashlib
import math
import re
import string

import pytest

from veridock.llm.decontaminate import decontaminate, find_windows, without_contaminated
from veridock.llm.exact_dedup import exact_dedup
from veridock.llm import licenses
from veridock.llm.licenses import BASE_PHRASES, license_scan
from veridock.llm.common import WORD

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
DOCS = "doc_id long, text string, source string, `Doc_Id` string, TEXT string"


def words(text):
    return re.findall(WORD, (text or "").translate(LOWER))


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def clashing(spark, rows):
    """The rows with more columns, two of which differ from the wanted ones in case only."""
    df = table(spark, rows).toDF("doc_id", "text").selectExpr("doc_id", "text", "'s' source", "'x' other", "'y' more")
    return df.toDF("doc_id", "text", "source", "Doc_Id", "TEXT")


LONG = "Lorem ipsum dolor " * 2000
EXACT = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "abc "), (6, "Äbc"), (7, "äbc"), (8, LONG), (9, LONG.upper()), (10, LONG + "x"), (10, "abc"), (None, "ABC"), (11, "z" * 40), (12, "z" * 24), (13, "z" * 40)]


@pytest.mark.parametrize("block_bytes", [8, 4096])
def test_exact_dedup_is_brute_force(spark, block_bytes):
    groups = {}
    for doc_id, text in EXACT:
        groups.setdefault((text or "").translate(LOWER), []).append(doc_id)
    got = exact_dedup(clashing(spark, EXACT), block_bytes).collect()
    want = sorted((repr(i), max((x for x in groups[(t or "").translate(LOWER)] if x is not None), default=None), len(groups[(t or "").translate(LOWER)]), hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()) for i, t in EXACT)
    assert sorted((repr(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.kept is False or r.doc_id == r.keep_id for r in got)


def test_exact_dedup_repeated_rows_and_empty_table(spark):
    got = exact_dedup(table(spark, [(1, "a"), (1, "a"), (None, "b")])).collect()
    assert sorted((repr(r.doc_id), r.group_size, r.kept) for r in got) == [("1", 2, False), ("1", 2, True), ("None", 1, True)]
    assert exact_dedup(table(spark, [])).count() == 0


ITEM = "one two three four five six seven eight nine ten eleven twelve"
BENCH = [(100, ITEM), (101, "short item"), (102, None), (103, "!!"), (104, ITEM.upper()), (9, "ten ten ten")]
TEXTS = [
    (1, f"before {ITEM.title()}, after"),
    (2, "two, three four five six seven eight nine ten eleven"),
    (3, "two three four five six seven eight nine ten"),
    (4, "a Short Item! short item"),
    (5, None),
    (6, ""),
    (7, "ten ten ten ten"),
    (8, " ".join(["filler"] * 3000 + ITEM.split())),
    (1, "another text with the id of the first"),
    (None, "short item"),
    (1, f"before {ITEM.title()}, after"),
]


def brute_decontaminate(docs, bench, window=10):
    grams = {}
    for item_id, text in bench:
        ws = words(text)
        for i in range(max(1, len(ws) - window + 1) if ws else 0):
            grams.setdefault(tuple(ws[i : i + window]), set()).add(str(item_id))
    out = []
    for doc_id, text in docs:
        ws, hit, items = words(text), set(), set()
        for gram, owners in grams.items():
            for s in range(len(ws) - len(gram) + 1):
                if tuple(ws[s : s + len(gram)]) == gram:
                    hit |= set(range(s, s + len(gram)))
                    items |= owners
        out.append((repr(doc_id), len(ws), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def rows_of(df):
    return sorted((repr(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def test_decontaminate_is_brute_force(spark):
    bench = table(spark, BENCH, "item_id long, text string")
    assert rows_of(decontaminate(clashing(spark, TEXTS), bench)) == brute_decontaminate(TEXTS, BENCH)


def test_decontaminate_without_broadcast(spark, monkeypatch):
    """A benchmark of any size: words then shuffle against prefix tokens."""
    from veridock.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    bench = table(spark, BENCH, "item_id long, text string")
    assert rows_of(decontaminate(table(spark, TEXTS), bench)) == brute_decontaminate(TEXTS, BENCH)


def test_decontaminate_empty_tables(spark):
    none = table(spark, [], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate(table(spark, TEXTS), none).collect())
    assert decontaminate(table(spark, []), table(spark, BENCH, "item_id long, text string")).count() == 0


def test_contaminated_documents_go_with_all_columns(spark):
    docs = table(spark, [(i, t) for i, t in TEXTS]).selectExpr("doc_id", "text", "'k' kept_column")
    left = without_contaminated(docs, table(spark, BENCH, "item_id long, text string"))
    assert left.columns == ["doc_id", "text", "kept_column"]
    want = [k for k, r in zip(TEXTS, [brute_decontaminate([d], BENCH)[0] for d in TEXTS], strict=True) if not r[5]]
    assert sorted(map(repr, [(r.doc_id, r.text) for r in left.collect()])) == sorted(map(repr, want))


def test_find_windows_reports_positions(spark):
    grams = spark.createDataFrame([(0, ["b", "c"])], "gid long, gram array<string>")
    got = find_windows(table(spark, [(1, "a b c b c")]), grams).select("start", "stop").collect()
    assert sorted((r.start, r.stop) for r in got) == [(1, 3), (3, 5)]


LICENSED = [
    (1, "Released under the MIT License. MIT license again"),
    (2, "GNU General Public License"),
    (3, "gnu general public\nlicense, Apache License; CC BY-NC 4.0 and cc by"),
    (4, None),
    (5, ""),
    (6, "mit license mit license mit"),
    (7, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (8, "person obtaining a copy"),
    (9, "Licensed under CC BY-NC 4.0."),
    (10, "cc cc by by cc"),
    (11, "word " * 5000 + "apache license"),
    (11, "word " * 5000 + "apache license"),
    (None, "the apache license"),
]


def test_license_base_is_brute_force(spark):
    got = {(repr(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan(clashing(spark, LICENSED)).collect()}
    want = set()
    for doc_id, text in LICENSED:
        ws = words(text)
        found = [(s, label) for phrase, label in BASE_PHRASES for s in range(len(ws)) if ws[s : s + len(phrase.split())] == phrase.split()]
        starts = [s for s, _ in found]
        want.add((repr(doc_id), len(ws), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))))
    assert got == want
    assert license_scan(clashing(spark, LICENSED)).count() == len(LICENSED)


def brute_licenses(texts):
    """(labels, score) of every text: every template tried at every place of every text."""
    rows, docs = licenses.template_rows(), [words(t) for t in texts]
    df = {w: sum(w in set(d) for d in docs) for r in rows for w in r[3]}
    idf = {w: math.log(1 + (len(docs) + 1) / (n + 1)) for w, n in df.items()}
    weight = [sum(idf[w] for w in r[3]) for r in rows]
    longest = {r[2]: max(x for x, q in zip(weight, rows, strict=True) if q[2] == r[2]) for r in rows}
    out = []
    for d in docs:
        labels, score = set(), 0.0
        for own, (_, kind, label, ws, key, key_at) in zip(weight, rows, strict=True):
            first = sorted((-idf[w], k, w) for k, w in enumerate(ws) if ws.index(w) == k)
            rare = first[: 1 if kind == "base" else licenses.RARE_WORDS]
            for at in range(-len(ws), len(d)):
                if at + key_at < 0 or d[at + key_at : at + key_at + len(key)] != key:
                    continue
                stands = lambda k, w: 0 <= at + k < len(d) and d[at + k] == w  # noqa: B023, E731
                agree = sum(-n for n, k, w in rare if stands(k, w))
                if kind == "base" or agree and agree >= licenses.AGREE * sum(-n for n, _, _ in rare) - 1e-9:
                    labels.add(label)
                    share = sum(idf[w] for k, w in enumerate(ws) if stands(k, w))
                    score = max(score, share / (longest[label] if kind == "base" else own))
        out.append((",".join(sorted(labels)), round(min(1.0, score), 4)))
    return out


def test_license_labels_and_score_are_brute_force(spark):
    """Whole wordings score near 1, damaged ones less, mentions little; also cut at the start and in a long text."""
    mit, bsd, apache = (licenses.TEXTS[k][1] for k in (0, 1, 5))
    texts = [t for _, t in LICENSED] + [f"x y {mit} z", mit.replace("Software", "Work"), bsd, " ".join(bsd.split()[20:]), "le " * 3000 + mit + " le" * 3000, apache, "mit mit mit", "see the MIT license"]
    got = sorted(license_scan(table(spark, list(enumerate(texts)))).collect())
    want = brute_licenses(texts)
    assert [(r.labels, round(r.score, 4)) for r in got] == want
    by_text = {t: w for t, w in zip(texts, want, strict=True)}
    assert by_text[f"x y {mit} z"] == ("mit", 1.0) and 0 < by_text["see the MIT license"][1] < 0.2 and by_text["mit mit mit"] == ("", 0.0)


def test_license_templates_need_their_key_phrase(spark):
    rows = {r.doc_id: r for r in license_scan(table(spark, LICENSED[:10])).collect()}
    assert rows[7].labels == "mit" and rows[7].n_base == 0 and rows[7].score == 1.0
    assert rows[8].labels == "" and rows[8].score == 0.0
    assert "cc-by-nc" in rows[9].labels and rows[9].base_labels == "cc-by"
    assert license_scan(table(spark, [])).count() == 0
