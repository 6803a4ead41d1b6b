"""Language of a text: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, all but letters becomes one space, and its 1- to 3-grams are
hashed into buckets. Counts of (language, bucket) are gathered over all training
rows on the cluster; what reaches the driver is at most one count per language and
bucket, so its size is fixed by ``MODEL_BYTES`` and not by the corpus. The matrix of
log probabilities is broadcast, and a batch of texts is scored as one sparse matrix
of counts against it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_slices, slices
from .common import drop_table, pick, write_table

BUCKETS = 1 << 16
GRAMS = 3
#: Bound of the broadcast matrix; with more languages than fit, buckets are folded in halves, down to the least number.
MODEL_BYTES = 32 * 1024 * 1024
LEAST_BUCKETS = 1 << 10
#: Added to every count: Lidstone smoothing.
ALPHA = 0.1
#: Characters hashed at a time; bounds a task's memory beside its longest text.
PIECE = 1 << 19
UNKNOWN = "und"
#: A letter in Java's and in Python's terms: categories L*, here for ``rlike``.
LETTER = r"\p{L}"
_OTHER = re.compile(r"[\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, code point) arrays of the normalised texts, each text between spaces, in pieces.

    Pieces of one text overlap by ``GRAMS - 1`` characters, marked by row -1.
    """
    rows, parts, size = [], [], 0
    for k, text in enumerate(texts):
        plain = " " + _OTHER.sub(" ", (text or "").lower()).strip(" ") + " "
        for at in range(0, len(plain), PIECE):
            before = plain[max(at - GRAMS + 1, 0) : at]
            part = before + plain[at : at + PIECE]
            rows.append(np.concatenate([np.full(len(before), -1, np.int64), np.full(len(part) - len(before), k, np.int64)]))
            parts.append(part)
            size += len(part)
            if size >= PIECE:
                yield _joined(rows, parts)
                rows, parts, size = [], [], 0
    if parts:
        yield _joined(rows, parts)


def _joined(rows: list[np.ndarray], parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
    return np.concatenate(rows), codes.astype(np.uint64)


def gram_buckets(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram; a gram belongs to the row of its last character.

    Grams that begin in another text, and a lone space, count for nothing.
    """
    rows, buckets = [], []
    h = np.zeros(len(code), np.uint64)
    edge = np.concatenate([[True], (row[1:] != row[:-1]) & (row[:-1] >= 0)]) if len(row) else np.zeros(0, bool)
    text = np.cumsum(edge)
    for n in range(GRAMS):
        h = (h[1:] if n else h) * _MIX + code[: len(code) - n] + np.uint64(1)
        last = row[n:]
        on = (last >= 0) & (text[n:] == text[: len(text) - n])
        if n == 0:
            on &= code != 32
        mixed = (h ^ (h >> np.uint64(29))) * _MIX
        rows.append(last[on])
        buckets.append((mixed >> np.uint64(48)).astype(np.int64)[on])
    return np.concatenate(rows), np.concatenate(buckets)


def sparse_counts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Piece by piece the sparse matrix of counts: (row, bucket, count), ordered by row."""
    for row, code in pieces(texts):
        rows, buckets = gram_buckets(row, code)
        keys, counts = np.unique(rows * BUCKETS + buckets, return_counts=True)
        yield keys // BUCKETS, keys % BUCKETS, counts


@dataclass
class NaiveBayes:
    """Languages in order, log prior of each, log probability of (bucket, language)."""

    languages: list[str]
    prior: np.ndarray
    logp: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the likeliest language of each text and its posterior probability; of equal ones the first."""
        joint = np.tile(self.prior, (len(texts), 1))
        for rows, buckets, counts in sparse_counts(texts):
            if len(rows):
                first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                joint[rows[first]] += np.add.reduceat(self.logp[buckets % len(self.logp)] * counts[:, None], first)
        best = joint.argmax(1)
        odds = np.exp(joint - joint.max(1, keepdims=True))
        return best, 1 / odds.sum(1)


def fit(languages: list[str], texts: np.ndarray, counts: np.ndarray) -> NaiveBayes:
    """From the number of training texts and the gram counts (bucket, language) of each language."""
    smooth = counts + ALPHA
    return NaiveBayes(languages, np.log(texts / max(texts.sum(), 1)), np.log(smooth / smooth.sum(0)).astype(np.float32))


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of (lang, text); every task adds up its own first.

    A task holds a vector of counts per language it has met, at most ``MODEL_BYTES``
    of them before it hands its sums on.
    """
    most = MODEL_BYTES // (8 * BUCKETS)

    def run(batches):
        sums: dict[str, np.ndarray] = {}

        def handed_on():
            for lang in sorted(sums):
                at = np.flatnonzero(sums[lang])
                yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(sums[lang][at], pa.int64())})
            sums.clear()

        for langs, texts in slices(batches):
            for lang in sorted(set(langs)):
                if lang not in sums and len(sums) >= most:
                    yield from handed_on()
                total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for row, code in pieces([t for t, own in zip(texts, langs, strict=True) if own == lang]):
                    total += np.bincount(gram_buckets(row, code)[1], minlength=BUCKETS)
        yield from handed_on()

    return rows.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(rows: DataFrame) -> NaiveBayes | None:
    """Fit on all rows of (lang, text) with a lang; none without any.

    Raises if there are more languages than ``MODEL_BYTES`` holds at ``LEAST_BUCKETS``.
    """
    known = rows.where("lang IS NOT NULL")
    most = MODEL_BYTES // (8 * LEAST_BUCKETS)
    seen = known.groupBy("lang").count().orderBy("lang").limit(most + 1).collect()
    if len(seen) > most:
        raise ValueError(f"more than {most} languages to learn")
    if not seen:
        return None
    languages = [r["lang"] for r in seen]
    size = BUCKETS
    while size > LEAST_BUCKETS and 8 * size * len(languages) > MODEL_BYTES:
        size //= 2
    table = write_table(gram_counts(known).groupBy("lang", (F.col("bucket") % size).alias("bucket")).agg(F.sum("n").alias("n")), "gram_counts")
    # At most one row per language and bucket: MODEL_BYTES of counts.
    got = table.toArrow()
    drop_table(table)
    counts = np.zeros((size, len(languages)), np.float64)
    place = {lang: k for k, lang in enumerate(languages)}
    column = np.array([place[lang] for lang in got["lang"].to_pylist()], int)
    counts[got["bucket"].to_numpy(), column] = got["n"].to_numpy()
    return fit(languages, np.array([r["count"] for r in seen], float), counts)


def predict_language(docs: DataFrame, model: NaiveBayes | None) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, from the text alone and without a shuffle.

    Null texts and texts without a letter are ``und`` with score 0, as is every text
    where nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(ids, texts, lettered):
        nb = shared.value
        if nb is None:
            return [ids, [UNKNOWN] * len(ids), [0.0] * len(ids)]
        best, score = nb.predict(texts)
        return [ids, [nb.languages[b] if on else UNKNOWN for b, on in zip(best, lettered, strict=True)], [float(s) if on else 0.0 for s, on in zip(score, lettered, strict=True)]]

    rows = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("lettered"))
    return map_slices(rows, run, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Learns from the rows with a lang whose crc32(doc_id as text) mod 4 is not 2, over
    all of them and whole texts (null counts as empty); a null doc_id is neither
    learned from nor held out. lang, source and doc_id are never inputs of a
    prediction, so rows with equal texts get equal answers. Repeated rows stay;
    an empty table gives no rows; extra columns are ignored.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = train(pick(docs, doc_id="doc_id", text="text", lang="lang").where(fold != 2).select("lang", "text"))
    return predict_language(docs, model).select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
