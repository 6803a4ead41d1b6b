"""Memos bounded by bytes, lanes that commit on convergence, and the codec on tables of all kinds."""

import random

import numpy as np
import pytest

import corpus_pipeline
from veridock.llm import memo, sp_codec, toxicity
from veridock.llm.memo import Memo
from veridock.llm.queries import tokenizer_path
from veridock.llm.sp_codec import sentencepiece_codec


def test_a_memo_stays_below_its_bytes_and_keeps_no_long_strings():
    m = Memo(20_000)
    for k in range(200):
        keys = [f"key{k}-{j}" for j in range(5)] + ["x" * (memo.LONGEST + 1 + k)]
        ids_of = m.learn(keys, lambda ks: [s.encode() for s in ks])
        assert [ids_of(s) for s in keys] == [s.encode() for s in keys]
        m.turn()
        assert m.bytes <= 10_000 + 2_500 and all(len(s) <= memo.LONGEST for s in [*m.new, *m.old])
    made = []
    ids_of = m.learn([f"key199-{j}" for j in range(5)], lambda ks: made.extend(ks) or [b"new"] * len(ks))
    assert ids_of("key199-0") in (b"key199-0", b"new")


def test_long_words_are_not_remembered_by_toxicity():
    long = "w" * 500
    assert toxicity.term_buckets(long) == toxicity.term_buckets(long) and long not in toxicity._CACHE


@pytest.fixture(scope="module")
def codec():
    return sp_codec.codec(tokenizer_path("piece_bpe_32k.model"))


@pytest.mark.parametrize("meet", [1, 4, 1000])
def test_lanes_equal_the_stream_however_often_paths_are_compared(codec, monkeypatch, meet):
    monkeypatch.setattr(sp_codec, "MEET", meet)
    rng = random.Random(meet)
    pieces = [p for p in codec.ids if p.strip(sp_codec.SPACE)]
    stretches = list(dict.fromkeys(sp_codec.SPACE + "".join(rng.choice(pieces).replace(sp_codec.SPACE, "") for _ in range(rng.randint(1, 9)))[:60] for _ in range(400)))
    got = codec.lanes(stretches)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [list(codec.stream(s)) for s in stretches]


def test_lanes_commit_before_a_stretch_ends(codec, monkeypatch):
    done = []
    real = sp_codec.Codec._met
    monkeypatch.setattr(sp_codec, "MEET", 1)
    monkeypatch.setattr(sp_codec.Codec, "_met", lambda self, *a: done.append(real(self, *a)) or done[-1])
    ids = codec.lanes([sp_codec.SPACE + "internationalorganisationsofthe"])[0]
    early = sum(len(lanes) for part in done[:-1] for lanes, _ in part)
    assert 0 < early <= len(ids) // 4


def test_tokenization_of_tables_of_all_kinds(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, " x "), (4, "z" * 100_000), (5, "漢字" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'n' AS ids", "1 AS TEXT_", "2 AS Doc")
    got = corpus_pipeline.tokenization(spark, df, "").collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got)
    assert [r["n_tokens"] for r in got if r["doc_id"] in (1, 2)] == [0, 0]
    assert sentencepiece_codec(df.limit(0), tokenizer_path("piece_bpe_32k.model")).count() == 0
