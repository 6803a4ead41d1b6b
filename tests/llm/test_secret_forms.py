"""Forms in which keys are commonly kept: quoted, wrapped, short, elliptic."""

import base64
import json
import textwrap
import time

import pytest

from test_text_operators import KEY, der
from veridock.llm.secret_scan import secret_scan, structural_spans

B64 = base64.b64encode(KEY).decode()
EC = der(0x30, der(2, b"\1") + der(4, bytes(range(32))))


def wrap(body, width):
    return "\n".join(textwrap.wrap(body, width))


def pem(body, kind="PRIVATE KEY"):
    return f"-----BEGIN {kind}-----\n{body}\n-----END {kind}-----\n"


@pytest.mark.parametrize("breaks", ["\\n", "\\r\\n", "\\\\n"])
def test_quoted_pem(breaks):
    text = 'x {"private_key": "' + pem(wrap(B64, 64)).replace("\n", breaks) + '"} y'
    ((kind, start, end),) = structural_spans(text)
    assert kind == "pem" and text[start:end].startswith("-----BEGIN") and text[start:end].endswith("KEY-----")


def test_json_with_escaped_slashes():
    assert [k for k, _, _ in structural_spans(json.dumps(pem(wrap(B64, 64))).replace("/", "\\/"))] == ["pem"]


@pytest.mark.parametrize("width", [60, 64, 70, 76])
@pytest.mark.parametrize("body", [B64, B64.rstrip("="), KEY.hex()])
@pytest.mark.parametrize("around", ["{}", "key:\n{}\nThen more text", "a-long-word-before-it\n{}\n\nend", "key: {} end"])
@pytest.mark.parametrize("breaks", ["\n", "\r\n", "\\n", "\n  "])
def test_wrapped_without_armour(width, body, around, breaks):
    lines = wrap(body, width)
    text = around.format(lines).replace("\n", breaks)
    lines = lines.replace("\n", breaks)
    at = text.index(lines)
    assert structural_spans(text) == [("der", at, at + len(lines))]


def test_wrapped_text_and_uneven_lines():
    body = base64.b64encode(b"some words before the line, password=hunter2 and after it" * 2).decode()
    assert [k for k, _, _ in structural_spans(wrap(body, 76))] == ["encoded"]
    assert [k for k, _, _ in structural_spans(f"{B64[:71]}\n{wrap(B64[71:], 76)}\nmore")] == ["der"]


def test_short_and_elliptic():
    for inner in (b"password=hunter2", b"token=abcdef"):
        assert [k for k, _, _ in structural_spans("v " + base64.b64encode(inner).decode())] == ["encoded"]
        assert [k for k, _, _ in structural_spans("v " + inner.hex())] == ["encoded"]
    assert [k for k, _, _ in structural_spans("v " + base64.b64encode(EC).decode())] == ["der"]
    assert [k for k, _, _ in structural_spans(pem(wrap(base64.b64encode(EC).decode(), 64), "EC PRIVATE KEY"))] == ["pem"]


def test_plain_text_stays_unreported_and_fast():
    assert structural_spans("internationalization\nof the\nextraordinarily-long-words\nin lines " + base64.b64encode(b"nothing to see here").decode()) == []
    began = time.time()
    structural_spans("\n".join(["MIIB" + "A" * 60] * 5000) + "\n" + "A" * 300_000)
    assert time.time() - began < 10


def test_rows(spark):
    rows = [(1, 'k "' + pem(wrap(B64, 64)).replace("\n", "\\n") + '"'), (2, wrap(B64, 76)), (3, "plain")]
    assert {r.doc_id: r.n_confirmed for r in secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: 1, 2: 1, 3: 0}
