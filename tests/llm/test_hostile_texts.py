"""Texts that are made to hang or to crash a scan, and scripts without spaces."""

import base64
import time

import pytest

from veridock.llm import pii
from veridock.llm.queries import DEMO_KEY
from veridock.llm.secret_scan import scan_texts, secret_scan, structural_spans


def b64(data):
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


DEEP = b64(b'{"a":' + b"[" * 200_000)
TOKEN = ".".join([b64(b'{"alg":"HS256"}'), b64(b'{"sub":"x"}'), b64(b"s" * 32)])


def seconds(fn, *args):
    began = time.perf_counter()
    fn(*args)
    return time.perf_counter() - began


@pytest.mark.parametrize("text", [f"x {DEEP}.{DEEP}.abc y", "eyJ" * 200_000, "eyJa." * 60_000, "-----BEGIN PRIVATE KEY-----" * 8_000, "a" * 400_000, "ab12" * 100_000 + "\n" + "ab12" * 100_000])
def test_secret_scan_takes_any_text(text):
    assert seconds(structural_spans, text) < 5


def test_a_deep_header_leaves_other_finds(spark):
    text = f"{DEEP}.{DEEP}.abc and {TOKEN}"
    rows = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secret_scan(rows).collect()}
    start = len(text) - len(TOKEN)
    assert got[1].split(",")[-1] == f"token:{start}:{len(text)}" and got[2] == ""


def test_token_after_letters_is_found_at_its_first_mark():
    assert structural_spans(f"id-{TOKEN} .{TOKEN}") == [("token", 3, 3 + len(TOKEN)), ("token", 5 + len(TOKEN), 5 + 2 * len(TOKEN))]
    assert scan_texts([1], [f"x{TOKEN}"])[6] == [1]


@pytest.mark.parametrize("letters", ["A" + "b" * 100_000, "王" * 100_000, "ก" * 100_000, "カ" * 100_000, "Ab-" * 30_000, "Ab " * 30_000])
def test_long_runs_after_a_title_take_linear_time(letters):
    assert seconds(pii.find, f"Mr {letters} and Mr Smith " + "Smith " * 1_000) < 3


def test_many_names_in_one_text_take_linear_time():
    text = " ".join(f"Mr {c}{d}{e} Smith" for c in "ABCDEFGHIJ" for d in "abcdefghij" for e in "abcdefghij")
    assert seconds(pii.find, text * 5) < 3


def names(text):
    return [text[s:e] for k, s, e in pii.find(text) if k == "name"]


def test_names_end_in_scripts_without_spaces():
    assert names("Mr 王小明說他很好") == ["王小明說"]
    assert names("Herr カタカナさん") == ["カタカナ"]
    assert names("Mr 王小明。後來王小明說。") == ["王小明", "王小明"]
    assert names("Mr " + "A" + "b" * 70 + " here") == []
    assert names("Dr Smith met smith, SMITH and Smithson; Mrs Jean-Luc O'Neil, O'Neil.") == ["Smith", "SMITH", "Jean-Luc O'Neil", "O'Neil"]


def test_addresses_of_one_domain_keep_one_domain(spark):
    rows = [(1, "ann@firm.example and bob@firm.example"), (2, "eve@FIRM.example, x@other.example")]
    out = dict(pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), DEMO_KEY).select("doc_id", "text").collect())
    first, second = out[1].split(" and ")
    assert first.split("@")[1] == second.split("@")[1] != "firm.example"
    assert out[2].split(", ")[0].split("@")[1].casefold() == first.split("@")[1]
    assert out[2].split("@")[2] != first.split("@")[1]
