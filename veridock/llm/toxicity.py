"""Toxicity with a factorization machine over hashed terms.

Terms are words and their first letters, hashed into buckets. Every term has a
weight and a vector; the product of two vectors is the weight of the pair, so an
insult beside a group mention can count for more than either alone. Buckets are
chosen by their association with the label, over all labelled training rows and
again over those that hold a suspicious bucket, so that a term which tells nothing
alone can still enter pairs. Both are counted on the cluster; only the chosen
buckets of a bounded sample of rows reach the trainer.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_slices
from .common import WORD, back, broadcast_if_small, by_position, checkpoint, drop_table, pick, write_table
from .memo import LONGEST

BUCKETS = 1 << 20
#: Bound of the labelled sample that the model is fitted on (rows in order of a hash of doc_id).
MAX_TRAIN_ROWS = 20_000
#: Least chi-square against the label, and least rows, of a bucket that gets weights.
LEAST_GAIN, LEAST_ROWS = 6.0, 3
FACTORS = 8
_WORD = re.compile(WORD)
_CACHE: dict[str, tuple[int, ...]] = {}
#: Words that a worker process remembers, none longer than ``LONGEST`` characters: at most 400 bytes each.
_CACHE_WORDS = 200_000


def term_buckets(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its first four and five letters."""
    got = _CACHE.get(word)
    if got is None:
        if len(_CACHE) >= _CACHE_WORDS:
            _CACHE.clear()
        terms = ["w" + word] + ["p" + word[:n] for n in (4, 5) if len(word) > n]
        got = tuple(zlib.crc32(t.encode()) % BUCKETS for t in terms)
        if len(word) <= LONGEST:
            _CACHE[word] = got
    return got


def text_buckets(text: str | None) -> set[int]:
    out: set[int] = set()
    for word in set(_WORD.findall((text or "").lower())):
        out.update(term_buckets(word))
    return out


@dataclass
class FactorizationMachine:
    """Sparse binary features: buckets (sorted), bias, weights and vectors."""

    buckets: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, present: set[int]) -> float:
        i = [k for k in map(self.index().get, present) if k is not None]
        z = self.bias
        if i:
            s = self.v[i]
            z += self.w[i].sum() + 0.5 * float((s.sum(0) ** 2 - (s * s).sum(0)).sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def index(self) -> dict[int, int]:
        if not hasattr(self, "_index"):
            self._index = {int(b): k for k, b in enumerate(self.buckets)}
        return self._index


def fit(features: list, labels: list[int], n: int, epochs: int = 20, rate: float = 0.1, l2: float = 1e-4, seed: int = 7):
    """Mini-batch AdaGrad on the logistic loss; features are indices below n."""
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(n), rng.normal(0, 0.02, (n, FACTORS)), 0.0
    gw, gv, gb = np.full(n, 1e-6), np.full((n, FACTORS), 1e-6), 1e-6
    y = np.array(labels, float)
    if len(y):
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        bias = math.log(p / (1 - p))
    size = np.array([len(f) for f in features], int)
    flat = np.concatenate([np.asarray(f, np.int32) for f in features]) if len(size) else np.zeros(0, np.int32)
    first = np.concatenate([[0], np.cumsum(size)])[:-1] if len(size) else np.zeros(0, int)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 256):
            pick_rows = order[at : at + 256]
            k = size[pick_rows]
            row = np.repeat(np.arange(len(pick_rows)), k)
            starts = np.concatenate([[0], np.cumsum(k)])[:-1]
            idx = flat[np.repeat(first[pick_rows] - starts, k) + np.arange(k.sum())]
            vi = v[idx]
            s, q, some = np.zeros((len(pick_rows), FACTORS)), np.zeros(len(pick_rows)), k > 0
            if some.any():
                # A row's features lie side by side.
                s[some] = np.add.reduceat(vi, starts[some])
                q[some] = np.add.reduceat((vi * vi).sum(1), starts[some])
            z = bias + np.bincount(row, w[idx], len(pick_rows)) + 0.5 * ((s * s).sum(1) - q)
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick_rows]
            touched = np.flatnonzero(np.bincount(idx, minlength=n))
            dw = np.bincount(idx, err[row], n)[touched] / len(pick_rows) + l2 * w[touched]
            dz = err[row][:, None] * (s[row] - vi)
            dv = np.stack([np.bincount(idx, dz[:, f], n)[touched] for f in range(FACTORS)], 1) / len(pick_rows) + l2 * v[touched]
            gw[touched] += dw * dw
            gv[touched] += dv * dv
            w[touched] -= rate * dw / np.sqrt(gw[touched])
            v[touched] -= rate * 0.3 * dv / np.sqrt(gv[touched])
            db = err.mean()
            gb += db * db
            bias -= rate * db / math.sqrt(gb)
    return bias, w, v


def associated(rows: DataFrame) -> list[tuple[int, bool]]:
    """(bucket, if it is found in toxic rows more than twice as often) of the buckets associated with the label in these rows."""
    total, positive = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = positive / max(total, 1)
    counts = rows.select("toxic", F.explode("buckets").alias("b")).groupBy("b").agg(F.count("*").alias("n"), F.sum("toxic").alias("p"))
    expected = F.col("n") * F.lit(share)
    gain = (F.col("p") - expected) ** 2 / F.greatest(expected, F.lit(1e-9))
    # At most one row per bucket, of which there is a fixed number.
    return [tuple(r) for r in counts.where((F.col("n") >= LEAST_ROWS) & (gain >= LEAST_GAIN)).select("b", F.col("p") > 2 * expected).collect()]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> FactorizationMachine:
    """Fit on labelled rows whose crc32(doc_id as text) mod 5 is not 0; without any, every score is near 0.

    Buckets are chosen over all such rows, weights fitted on at most ``max_rows``
    of them. A doc_id with several labels counts as toxic if one of them says so;
    of its texts the one of smallest hash is taken.
    """
    known = pick(labels, doc_id="doc_id", toxic="toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.max(F.col("toxic") > 0).cast("int").alias("toxic"))
    known, _ = broadcast_if_small(checkpoint(known), F.lit(16))

    def buckets(ids, toxic, text):
        return [ids, toxic, [sorted(text_buckets(t)) for t in text]]

    texts = pick(docs, doc_id="doc_id", text="text").join(known, "doc_id").select("doc_id", "toxic", "text")
    rows = write_table(map_slices(texts, buckets, "doc_id long, toxic int, buckets array<int>"), "toxic_terms")
    marginal = associated(rows)
    suspicious = frozenset(b for b, more in marginal if more)

    def hold(toxic, buckets):
        on = [k for k, bs in enumerate(buckets) if not suspicious.isdisjoint(bs)]
        return [[toxic[k] for k in on], [buckets[k] for k in on]]

    held = map_slices(rows.select("toxic", "buckets"), hold, "toxic int, buckets array<int>")
    names = np.array(sorted({b for b, _ in marginal} | {b for b, _ in associated(held)}), int)
    index = {int(b): k for k, b in enumerate(names)}
    sample = checkpoint(rows.groupBy("doc_id").agg(F.min(F.hash("buckets")).alias("pick")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    one = rows.join(F.broadcast(sample), "doc_id").where(F.hash("buckets") == F.col("pick")).dropDuplicates(["doc_id"]).select("toxic", "buckets")

    def kept(toxic, buckets):
        return [toxic, [np.array([index[b] for b in bs if b in index], "<i4").tobytes() for bs in buckets]]

    data = sorted((r["toxic"], bytes(r["f"])) for r in map_slices(one, kept, "toxic int, f binary").collect())
    drop_table(rows)
    bias, w, v = fit([np.frombuffer(f, "<i4") for _, f in data], [toxic for toxic, _ in data], len(names)) if data else (-6.0, np.zeros(len(names)), np.zeros((len(names), FACTORS)))
    return FactorizationMachine(names, float(bias), w, v)


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """doc_id, text-only score of every input row, in place of any shuffle; null texts score as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(ids, texts):
        fm = shared.value
        scores = [fm.score(text_buckets(t)) for t in texts]
        return [ids, scores, [int(s >= 0.5) for s in scores]]

    rows = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), "text")
    return map_slices(rows, run, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    labels, lang, source and doc_id are never inputs of a score. Null and empty
    texts get the model's prior. held_out is false for a null doc_id.
    """
    model = train(docs, labels)
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return score(docs, model).select("doc_id", F.coalesce(crc == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The input rows, all columns, whose text the model doesn't call toxic.

    Null and empty texts stay, unless the model's prior calls them toxic; repeated
    rows stay or go together. Extra columns may have any names. An empty table
    stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("boolean")
    def rejected(texts: pd.Series) -> pd.Series:
        fm = shared.value
        return pd.Series([fm.score(text_buckets(t)) >= 0.5 for t in texts], dtype=bool)

    plain, at = by_position(docs)
    return back(plain.where(~rejected(at["text"])), docs.columns)
