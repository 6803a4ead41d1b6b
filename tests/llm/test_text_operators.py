"""Secrets, token output, SentencePiece, toxicity and PII: brute force, round trips, held-out accuracy."""

import base64
import hashlib
import json
import os
import re
import struct
import zlib

import numpy as np
import pytest

from veridock.llm import pii, sp_codec, token_store, toxicity
from veridock.llm.queries import DEMO_KEY, tokenizer_path
from veridock.llm.secret_scan import base_spans, secret_scan, structural_spans

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def der(tag, body):
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + struct.pack(">H", len(body))
    return bytes([tag]) + size + body


KEY = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([k + 1] * 40)) for k in range(8)))


def token(header, payload=b'{"sub":"x"}', sign=b"s" * 32):
    return ".".join(base64.urlsafe_b64encode(p).decode().rstrip("=") for p in (header, payload, sign))


def test_base_spans_are_leftmost_and_drop_failures():
    text = 'Password: "abcdef" secret=abc token = 0123456789abcdef01234567 AKIA' + "A" * 16 + " AKIAshort"
    assert base_spans(text)[0] == ("assign", 0, 17)
    kinds = [k for k, _, _ in base_spans(text)]
    assert kinds == ["assign", "assign", "access", "hex"]
    assert base_spans("ſecret=abcdefg") == []


def test_structure_is_confirmed_before_reporting():
    good = token(b'{"alg":"HS256"}')
    assert [k for k, _, _ in structural_spans(f"x {good} y")] == ["token"]
    assert structural_spans("x " + token(b'{"typ":"JWT"}')) == []
    assert structural_spans("x " + token(b'{"alg":"HS256"}', sign=b"s")) == []
    b64 = base64.b64encode(KEY).decode()
    assert [k for k, _, _ in structural_spans(f"k {b64}")] == ["der"]
    assert [k for k, _, _ in structural_spans(f"k {KEY.hex()}")] == ["der"]
    assert structural_spans("k " + base64.b64encode(KEY[:-4] + b"zzzzzz").decode()) == []
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{b64}\n-----END RSA PRIVATE KEY-----"
    assert [k for k, _, _ in structural_spans(pem)] == ["pem"]
    hidden = base64.b64encode(b"password = hunter2hunter2 and more").decode()
    assert [k for k, _, _ in structural_spans(hidden)] == ["encoded"]


def test_secret_scan_edges(spark):
    rows = [(1, None), (2, ""), (3, "ä token: abcdef"), (3, "ä token: abcdef"), (None, "f" * 30), (4, "x " * 100_000 + "a" * 24)]
    got = secret_scan(table(spark, rows).selectExpr("doc_id", "text", "1 n_hex")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    empty = hashlib.sha256(b"").hexdigest()
    assert by[1].base_sha256 == by[2].base_sha256 == empty and by[1].spans == ""
    assert by[3].spans == "assign:2:15" and by[3].base_sha256 == hashlib.sha256(b"assign:2:15").hexdigest()
    assert by[None].n_hex == 1 and by[4].spans == "hex:200000:200024"
    assert secret_scan(table(spark, [])).count() == 0


TRICKY = ["", " ", "a", "a <|endoftext|> b", "<|endoftext|>", "Hello, world!  two  spaces\n\nnew\tline", "don't we'll 123 4567.89", " lead and trail ", "ünï ça 漢字 🙂", "a.b,c...", "x\n y \nz", "A" * 5000, "tab\there \t there", "word,\nNext.", "a b" * 5000]


@pytest.fixture(scope="module")
def real_texts():
    if not os.path.isdir(SF):
        return []
    import pyarrow.parquet as pq

    return [t or "" for t in pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist()]


def test_segment_encoding_equals_the_library(real_texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    enc = token_store.encoder(tokenizer_path("byte_bpe_50k.json"))
    for text in TRICKY + real_texts:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text[:80]


def test_token_files_hold_every_document(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = [(k, t) for k, t in enumerate(TRICKY)] + [(100, None), (101, "same"), (101, "same")]
    got = sorted(token_store.token_output(table(spark, rows).selectExpr("doc_id", "text", "0L start"), tokenizer_path("byte_bpe_50k.json")).collect())
    at, want = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    path = str(tmp_path / "tokens")
    token_store.write_tokens(table(spark, rows), tokenizer_path("byte_bpe_50k.json"), path)
    assert token_store.read_document(spark, path, 3) == [*tok.encode(TRICKY[3], add_special_tokens=False).ids, 2]
    assert token_store.token_output(table(spark, []), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_a_foreign_dictionary_is_refused():
    block = token_store.pack_block([b"x"], b"one")
    assert block[4:36] == token_store.dict_hash(b"one") != token_store.dict_hash(b"two")
    assert token_store.frame_of(token_store.pack_block([b"ab", b"", b"c"], b""), 2) == b"c"


@pytest.fixture(scope="module")
def codec():
    return sp_codec.Codec(tokenizer_path("piece_bpe_32k.model"))


def test_viterbi_equals_the_library(real_texts, codec):
    """Streams, alone and side by side, give the library's ids, also for odd spacing and characters without a piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    rng = np.random.default_rng(3)
    letters = list("ab  .\n aeiouéßж漢🙂▁1234thng")
    odd = ["".join(rng.choice(letters, rng.integers(0, 200))) for _ in range(300)] + ["x" * 3000, "anan" * 900, " "]
    for text, packed in zip(TRICKY + odd + real_texts, codec.encode_all(TRICKY + odd + real_texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == sp.encode(text), text[:80]
    for text in odd + real_texts[:30]:
        assert not text or list(codec.stream(f"▁{text}".replace(" ", "▁"))) == sp.encode(text), text[:80]


def test_compatibility_is_what_merging_leaves(codec):
    rng = np.random.default_rng(5)
    pieces = sorted(codec.ids, key=codec.ids.get)
    pairs = [(pieces[i], pieces[j]) for i, j in rng.integers(0, len(pieces), (400, 2))]
    for k in range(0, 4000, 10):
        word = pieces[k]
        pairs += [(word[:n], word[n:]) for n in range(1, len(word)) if word[:n] in codec.ids and word[n:] in codec.ids]
    want = [codec.merge(a + b)[0] == [a, b] for a, b in pairs]
    left, right = (np.array([codec.ids[p[x]] for p in pairs]) for x in (0, 1))
    assert codec.all_compatible(left, right).tolist() == want == [codec.compatible(int(a), int(b)) for a, b in zip(left, right)]
    assert any(want) and not all(want)


def test_codec_round_trips_and_streams_in_a_window(spark, codec):
    path = tokenizer_path("piece_bpe_32k.model")
    rows = [(k, t) for k, t in enumerate(TRICKY)] + [(100, None), (None, "x"), (None, "x")]
    got = sp_codec.sentencepiece_codec(table(spark, rows).selectExpr("doc_id", "text", "0 ids"), path).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    assert all(r.n_tokens == len(r.ids) for r in got)
    given, spoken, behind = 0, 0, 0

    def chars(n):
        nonlocal given, behind
        for k in range(n):
            behind = max(behind, given - spoken)
            given += 1
            yield "internationalisation"[k % 20]

    # No spaces at all: ids are committed wherever the surviving paths meet.
    for i in codec.stream(chars(10_000)):
        spoken += codec.lengths[i]
    assert spoken == 10_000 and behind <= 2 * codec.longest


def test_interactions_are_learned():
    """Either term alone is harmless; both together are not: additive weights can't tell."""
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2, 4000), rng.integers(0, 2, 4000)
    features = [[k for k, on in enumerate((x, y)) if on] for x, y in zip(a, b, strict=True)]
    labels = [int(x == y) for x, y in zip(a, b, strict=True)]
    bias, w, v = toxicity.fit(features, labels, 2, epochs=60)
    model = toxicity.FactorizationMachine(np.array([10, 11]), bias, w, v)
    assert model.score({10, 11}) > 0.5 > model.score({10}) and model.score({11}) < 0.5 < model.score(set())


@needs_tables
def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    pos, neg = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_toxicity_edges(spark):
    labels = table(spark, [(1, 1), (2, 0), (3, None), (None, 1), (1, 1)], "doc_id long, toxic int")
    rows = [(1, "bad"), (2, "good"), (3, None), (None, ""), (2, "good")]
    got = toxicity.toxicity(table(spark, rows).selectExpr("doc_id", "text", "9 score"), labels).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id in (None, 3)}) == 1
    assert toxicity.toxicity(table(spark, []), labels).count() == 0
    none = table(spark, [], "doc_id long, toxic int")
    assert all(r.predicted == 0 for r in toxicity.toxicity(table(spark, rows), none).collect())
    kept = toxicity.without_toxic(table(spark, rows), none)
    assert kept.columns == ["doc_id", "text"] and kept.count() == len(rows)


PRIVATE = [
    (1, "Mail Jo.Doe@Example.com or jo.doe@example.com, call +1 (017) 555-7713 97.51.17.173"),
    (2, "jo.doe@example.com; card 4111 1111 1111 1111 and 9807915762804490, Frau Müller, Mr. Adam SMITH"),
    (3, "Г-жа nobody, г-н Иванов; 123-45-6789; DE89 3704 0044 0532 0130 00; 2024-01-02 and 3.14"),
    (4, None),
    (5, ""),
    (6, "nothing here 12 34"),
    (2, "again jo.doe@example.com"),
    (None, "x 97.51.17.173"),
]


def test_pii_kinds_are_found():
    kinds = [[k for k, _, _ in pii.find(t)] for _, t in PRIVATE]
    assert kinds[0] == ["email", "email", "phone", "ip"]
    assert kinds[1] == ["email", "card", "card", "name", "name"]
    assert sorted(kinds[2]) == ["iban", "name", "ssn"]
    assert kinds[3] == kinds[4] == kinds[5] == []


def test_surrogates_are_consistent_distinct_and_typed(spark):
    got = pii.pseudonymize(table(spark, PRIVATE).selectExpr("doc_id", "text", "'q' spans"), DEMO_KEY).collect()
    assert len(got) == len(PRIVATE)
    texts = {(r.doc_id, r.n_found): r.text for r in got}
    for r in got:
        for real in ("jo.doe@", "555-7713", "97.51.17.173", "4111 1111", "9807915762804490", "Müller", "Иванов", "123-45-6789"):
            assert real.lower() not in (r.text or "").lower()
    mails = re.findall(r"\S+@\S+?\.com", texts[1, 4])
    assert mails[0].lower() == mails[1] and mails[0] != mails[1]
    assert mails[1] in texts[2, 1] and mails[1] in texts[2, 5]
    assert texts[None, 1].split()[1] == texts[1, 4].split()[-1]
    iban = re.search(r"DE\d\d(?: \d{4}){4} \d\d", texts[3, 3])[0].replace(" ", "")
    assert pii.iban_check("DE", iban[4:]) == iban[2:4]
    assert re.search(r"г-н [А-Я][а-я]+", texts[3, 3]) and "2024-01-02 and 3.14" in texts[3, 3]
    assert texts[6, 0] == "nothing here 12 34" and texts[5, 0] == "" and texts[4, 0] is None
    assert pii.pseudonymize(table(spark, []), DEMO_KEY).count() == 0


def test_given_names_follow_the_title():
    for title, gender in (("Mr", "m"), ("Frau", "f"), ("Herr", "m")):
        text = f"{title} Alex Doe"
        (entity, shown), = pii.resolve(text, pii.find(text))
        given, family = pii.dress_name("Alex Doe", entity, pii.name_surrogate(b"k", shown, entity, 0)).split()
        assert given in pii.GIVEN["latin", gender] and family.casefold() == pii.surrogate(b"k", "name", entity).split()[-1]


def test_colliding_entities_draw_again(spark):
    """Two-digit house: many one-letter mail boxes force collisions; all surrogates stay distinct."""
    entities = spark.createDataFrame([("email", f"{a}@{b}.io") for a in "abcdefghij" for b in "abcdefghij"], "kind string, entity string")
    values = [r.value for r in pii.assign(entities, b"k").collect()]
    real = {r.entity for r in entities.collect()}
    assert len(set(values)) == len(values) == 100 and not real & set(values)


def test_token_header_is_json():
    assert json.loads(base64.urlsafe_b64decode(token(b'{"alg":"none"}').split(".")[0] + "==")) == {"alg": "none"}
