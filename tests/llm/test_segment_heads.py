"""A segment's first word and what follows it are encoded once each, and give the library's ids."""

import random

import numpy as np
import pyarrow as pa
import pytest

from veridock.llm import token_store
from veridock.llm.arrow import slices
from veridock.llm.queries import tokenizer_path


@pytest.fixture()
def encoder():
    return token_store.Encoder(tokenizer_path("byte_bpe_50k.json"))


def test_a_word_before_other_punctuation_is_not_encoded_again(encoder, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnoé", k=12)) for _ in range(100)]
    ends = [",", ".", "!", "?", ";", ":", "...", "!!", ".\nThe", "'s", ")", "&&&", "-", "/x", "1"]
    texts = [" ".join(["First"] + [w + e for w in words]) for e in ["", *ends]]
    sent, ids = [], encoder.ids
    monkeypatch.setattr(encoder, "ids", lambda text: sent.append(len(text)) or ids(text))
    got = [encoder.encode(t) for t in texts]
    assert sum(sent) < 2 * len(texts[0])
    assert got == [ids(t).tobytes() for t in texts]


def test_segments_of_all_scripts_equal_the_library(encoder):
    rng = random.Random(5)
    alphabet = "abzAZ09éÀ×÷ßɏɐʰªºµ²½'’’ls_-.,!?<|>#$\"\t\n\r\x0b\x1c\x85\xa0̀́Ġ​ 　क्षあ漢😀퟿"
    texts = []
    for _ in range(3000):
        parts = ["".join(rng.choices(alphabet if rng.random() < 0.5 else alphabet[:24], k=rng.choice((0, 1, 2, 3, 5, 9, 80)) if rng.random() < 0.3 else rng.randint(1, 6))) for _ in range(rng.randint(1, 12))]
        texts.append(" ".join(parts))
    texts += ["it's we'll a'b l'homme,d'or x'", "a <|endoftext|> b,<|endoftext|>", "word,\n\nnext word.\n\tnext a", "\tx", "x\t y", "a,b a", ""]
    for at in range(0, len(texts), 64):
        part = texts[at : at + 64]
        for text, got in zip(part, encoder.encode_all(part), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == encoder.ids(text).tolist(), repr(text)


def test_a_tokenizer_of_another_kind_gets_texts_whole(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"a": 0, "b": 1, ",": 2, "?": 3}, unk_token="?"))
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.save(str(tmp_path / "other.json"))
    made = token_store.Encoder(str(tmp_path / "other.json"))
    assert np.frombuffer(made.encode("a b, b a,b c"), "<u4").tolist() == [0, 1, 2, 1, 0, 2, 1, 3]


def test_words_and_rests_are_remembered_apart_and_first_words_encoded_once(encoder, monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnoéȳ", k=11)) for _ in range(100)]
    ends = ["", ",", ".", "!", "?", ";", ":", "...", ".\nThe", ")"]
    texts = [" ".join(["First", *[w + rng.choice(ends) for w in words]]) for _ in range(300)]
    calls, ids = [], encoder.ids
    monkeypatch.setattr(encoder, "ids", lambda text: calls.append(text) or ids(text))
    got = encoder.encode_all(texts)
    assert len(calls) < 10
    assert len(encoder.memo.new) == len(set(words))
    assert len(encoder.rests.new) == len(ends) - 1
    assert got == [ids(t).tobytes() for t in texts]


def test_a_text_without_spaces_is_encoded_once(encoder, monkeypatch):
    texts = ["".join(random.Random(k).choices("abcé漢,.\n", k=500)) + "z" for k in range(20)]
    sent, ids = [], encoder.ids
    monkeypatch.setattr(encoder, "ids", lambda text: sent.append(len(text)) or ids(text))
    got = encoder.encode_all(texts)
    assert sum(sent) <= sum(map(len, texts))
    assert got == [ids(t).tobytes() for t in texts]


def test_signs_and_marks_beside_letters_are_no_word(encoder):
    heads = ["a×b", "a÷", "×", "÷a", "ȿ", "aȿ", "ɏa", "ɐ", "é́", "á", "ǃ", "aªb", "aʰ", "日本", "aя", "a​", "a­", "ɀ", "ƻ", "A" * 300]
    rests = ["", ",", "'s", "'S", ".\nÉa", "1×", "-÷", "\t", "\n", ".\r\n\r\nx", "\x1c", "\x85", "\xa0", "_", "\x00b", ",×́" * 40]
    texts = [f"{lead}{h}{r}{tail}" for h in heads for r in rests for lead in ("", "x ", "x. ") for tail in ("", " y", " y ", "\n")]
    for text, got in zip(texts, encoder.encode_all(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == encoder.ids(text).tolist(), repr(text)


def test_slices_are_bounded_by_bytes_and_lose_no_row():
    lens = [3, 0, 50, 9, 1, 1, 8, 200, 0, 10]
    table = pa.table({"k": list(range(len(lens))), "text": ["é" * n if n else None for n in lens]})
    for rows, most in ((4, 20), (100, 1), (1, 10**6), (100, 10**6)):
        parts = list(slices(iter(table.to_batches()), rows, most))
        assert [k for ks, _ in parts for k in ks] == list(range(len(lens)))
        assert all(len(ks) <= rows and (len(ks) == 1 or sum(len((t or "").encode()) for t in ts) <= most) for ks, ts in parts)
