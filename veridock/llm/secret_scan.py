"""Secret scans with structural confirmation.

Base patterns (assignments, access ids, long hex runs) are reported as found.
Further candidates, base64 or hex runs, also those wrapped over lines, are
reported only after they decode and their structure holds: token headers that are JSON with an algorithm, DER whose
nested lengths fill it exactly, OpenSSH containers whose length-prefixed fields
add up, and encoded text that itself contains an assignment or access id.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_slices
from .common import pick
from .spans import Spans

#: The base patterns. Group 2 of an assignment needs 6 characters, an access id 20, a hex run 24.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "pem", "token", "openssh", "der", "encoded")

PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([^-]*)-----END \1-----")
#: The first eyJ of a run counts, so each run is read once.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+)")
#: A line break as it is, or written out in a quoted string.
BREAK = r"(?:\r?\n|(?:\\+r)?\\+n)"
#: Twelve bytes are the shortest assignment that is reported: token=abcdef.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:(?<=\\)[nrt](?=[A-Za-z0-9+/_-]{16}))?([A-Za-z0-9+/_-]{16,}+={0,2})")
HEXRUN = re.compile(r"[0-9A-Fa-f]{24,}")
#: Lines of base64 or hex, the first of them at the end of a line.
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])(?:(?<=\\)[nrt])?([A-Za-z0-9+/_-]{{16,}}+(?:{BREAK}[ \t]*+[A-Za-z0-9+/_-]++)++={{0,2}})")
PIECE = re.compile(rf"(?:{BREAK}[ \t]*)|([A-Za-z0-9+/_-]+={{0,2}})")
LEAST = 16


def unbase64(text: str) -> bytes | None:
    """Standard or URL alphabet, padding optional; None if it is neither."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def unhex(text: str) -> bytes | None:
    return bytes.fromhex(text) if len(text) % 2 == 0 and HEXRUN.fullmatch(text) else None


def der_items(data: bytes, depth: int = 0) -> list | None:
    """Tags and contents of DER values that fill ``data`` exactly, nested values parsed; else None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or depth > 12:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > len(data):
            return None
        body = data[at : at + size]
        if tag & 0x20:
            body = der_items(body, depth + 1)
            if body is None:
                return None
        out.append((tag, body))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    """A private key: one SEQUENCE that starts with a small version INTEGER and holds key material."""
    if len(data) < 32 or data[0] != 0x30:
        return False
    items = der_items(data)
    if not items or len(items) != 1 or len(items[0][1]) < 2:
        return False
    first, rest = items[0][1][0], items[0][1][1:]
    numbers = sum(tag == 2 for tag, _ in rest)
    return first[0] == 2 and first[1] in (b"\0", b"\1") and (numbers >= 5 or any(tag == 4 and len(body) >= 16 for tag, body in rest))


def is_openssh_key(data: bytes) -> bool:
    """openssh-key-v1: cipher, kdf, options, a count, then keys and private part, all length-prefixed and complete."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, fields = len(magic), 0

    def take(at: int) -> int:
        size = int.from_bytes(data[at : at + 4], "big")
        return at + 4 + size if at + 4 <= len(data) and at + 4 + size <= len(data) else -1

    for _ in range(3):
        at = take(at)
        if at < 0:
            return False
    count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= count <= 16:
        return False
    while at < len(data) and fields <= count:
        at, fields = take(at), fields + 1
        if at < 0:
            return False
    return at == len(data) and fields == count + 1


def is_signed_token(text: str) -> bool:
    """header.payload.signature: both parts JSON objects, the header names an algorithm, the signature decodes."""
    head, body, sign = (unbase64(x) for x in text.split("."))
    try:
        header, payload = json.loads(head or b""), json.loads(body or b"")
    except (ValueError, RecursionError):
        # Nested beyond what the parser takes: no token header is.
        return False
    if not isinstance(header, dict) or not isinstance(payload, dict) or not isinstance(header.get("alg"), str):
        return False
    return sign is not None and (len(sign) >= 16 or header["alg"] == "none")


def _confirm(data: bytes | None) -> str | None:
    if not data:
        return None
    if is_der_key(data):
        return "der"
    if is_openssh_key(data):
        return "openssh"
    if all(32 <= b < 127 or b in (9, 10, 13) for b in data):
        inner = data.decode("ascii")
        if base_spans(inner)[:1] and any(k != "hex" for k, _, _ in base_spans(inner)):
            return "encoded"
    return None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and non-overlapping per kind."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if max(map(len, text.split()), default=0) >= 24:
        out += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return out


def der_chars(head: str) -> list[int]:
    """How many characters, without padding, a base64 or hex text has whose first ones start a DER SEQUENCE."""
    out = []
    for data, per in ((unbase64(head[:8]), 4 / 3), (unhex(head[:24]), 2)):
        if data and data[0] == 0x30:
            n = data[1] & 0x7F if data[1] & 0x80 else 0
            size = int.from_bytes(data[2 : 2 + n], "big") if n else data[1]
            if n <= 3:
                out.append(math.ceil((2 + n + size) * per))
    return out


def wrapped_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of candidates joined across line breaks.

    Tried are the lines from each on that make up the length its DER header
    names, lines of one width with and without a shorter last one, and all lines.
    """
    out = []
    for m in WRAPPED.finditer(text):
        pieces = [p.span(1) for p in PIECE.finditer(text, *m.span(1)) if p[1]]
        lines = [text[a:b] for a, b in pieces]
        sizes = [len(x.rstrip("=")) for x in lines]
        ends = list(accumulate(sizes))
        last, i, width_end = len(lines) - 1, 0, -1
        while i < last:
            before = ends[i] - sizes[i]
            tries = [j for n in der_chars(lines[i]) if (j := bisect_left(ends, before + n)) <= last and ends[j] == before + n]
            if i > width_end:
                width_end = i
                while width_end < last and sizes[width_end + 1] == sizes[i]:
                    width_end += 1
                tries += [width_end + 1] if width_end < last and sizes[width_end + 1] < sizes[i] else []
                tries += [width_end]
            if i == 0:
                tries.append(last)
            for j in dict.fromkeys(tries):
                whole = "".join(lines[i : j + 1])
                kind = j > i and (_confirm(unbase64(whole)) or _confirm(unhex(whole)))
                if kind:
                    out.append((kind, pieces[i][0], pieces[j][1]))
                    i = width_end = j
                    break
            i += 1
    return out


def structural_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of candidates whose decoded structure holds."""
    out = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            # In a quoted string line breaks are written out and slashes may be escaped.
            data = unbase64(re.sub(r"\\+r|[\s\\]", "", "".join(line for line in re.split(r"\n|\\+n", m[2]) if ":" not in line)))
            if data and (is_der_key(data) or is_openssh_key(data)):
                out.append(("pem", *m.span()))
    if "eyJ" in text:
        out += [("token", *m.span(1)) for m in TOKEN.finditer(text) if is_signed_token(m[1])]
    if max(map(len, text.split()), default=0) < LEAST:
        return out
    taken = Spans()
    for span in out:
        taken.add(*span)
    out += [span for span in wrapped_spans(text) if taken.add(*span)]
    for pattern, decode in ((BASE64, unbase64), (HEXRUN, unhex)):
        for m in pattern.finditer(text):
            # A letter after a backslash may belong to the run or to an escape.
            for start, end in dict.fromkeys([m.span(pattern.groups), m.span()]):
                if taken.free(start, end) and (kind := _confirm(decode(text[start:end]))):
                    out.append((kind, start, end))
                    taken.add(kind, start, end)
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan_texts(ids: list, texts: list) -> list[list]:
    cols: list[list] = [[] for _ in range(7)]
    for doc_id, text in zip(ids, texts, strict=True):
        base = base_spans(text or "")
        more = structural_spans(text or "")
        kinds = [k for k, _, _ in base]
        row = (doc_id, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more))
        for col, v in zip(cols, row, strict=True):
            col.append(v)
    return cols


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per input row: counts per base kind, digest of base spans, all spans, confirmed count.

    Offsets are code points of the whole text, ends exclusive. Null texts count
    as empty; empty texts have no spans. Rows need no shuffle, so repeated rows
    and null ids are kept as they are.
    """
    rows = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.col("text"))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"
    return map_slices(rows, scan_texts, schema)
