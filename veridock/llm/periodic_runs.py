"""Runs of words that repeat with a period: found on a harmonic grid, collapsed to one period.

Word x matches at distance p if word x + p is the same. A run of period p and
length m is a maximal stretch of m - p matches at distance p, and a run that counts
is at least ``max(LEAST_WORDS, LEAST_TURNS * p)`` long, so its stretch has
``max(LEAST_WORDS - p, (LEAST_TURNS - 1) * p)`` matches or more. One grid point every
so many words therefore hits each stretch, and all periods together need about
n log(n) / 2 points. From every point that matches, both ends of the stretch are
found by binary search over prefix hashes, for all points at once. A hash may only
stretch a run too far, so all finds are held against the words themselves; a text
in which one fails is done again with another base.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_slices
from .common import pick

#: What lies between words (all else is a word), and the least length of a run in words and in periods.
GAP = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_TURNS = 24, 3
#: Grid points searched at a time; bounds a task's memory beside its longest text.
POINTS = 1 << 18
_PRIME = (1 << 31) - 1
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo the prime, by doubling."""
    out = np.ones(n + 1, np.int64)
    done, top = 1, base
    while done <= n:
        part = min(done, n + 1 - done)
        out[done : done + part] = out[:part] * top % _PRIME
        top = top * top % _PRIME
        done += part
    return out


class PrefixHashes:
    """Equality of equally long word stretches that begin ``p`` words apart."""

    def __init__(self, ids: np.ndarray, base: int):
        self.power = powers(base, len(ids))
        self.sums = np.zeros(len(ids) + 1, np.int64)
        np.cumsum((ids + 1) % _PRIME * self.power[:-1] % _PRIME, out=self.sums[1:])
        self.sums %= _PRIME

    def same(self, lo: np.ndarray, hi: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Whether words lo..hi-1 are words lo+p..hi+p-1, by hash."""
        near = (self.sums[hi] - self.sums[lo]) % _PRIME * self.power[p] % _PRIME
        return near == (self.sums[hi + p] - self.sums[lo + p]) % _PRIME


def longest(most: np.ndarray, test) -> np.ndarray:
    """For every point the greatest length up to ``most`` that ``test(lengths)`` accepts; length 0 always holds."""
    lo, hi = np.zeros_like(most), most.copy()
    while (lo < hi).any():
        mid = (lo + hi + 1) >> 1
        held = test(mid)
        lo = np.where(held, mid, lo)
        hi = np.where(held, hi, mid - 1)
    return lo


def grid(n: int):
    """All (period, point) pairs of n words, at most about ``POINTS`` at a time."""
    p = np.arange(1, n // LEAST_TURNS + 1)
    step = np.maximum(LEAST_WORDS - p, (LEAST_TURNS - 1) * p)
    count = (n - p - 1) // step + 1
    upto = np.cumsum(count)
    at = 0
    while at < len(p):
        # A period of its own chunk may have more points: it is cut into ranges of points.
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + POINTS, "right")))
        for first in range(0, int(count[at]) if end == at + 1 else 1, POINTS):
            part = np.minimum(count[at:end] - first, POINTS if end == at + 1 else count[at:end])
            period = np.repeat(p[at:end], part)
            k = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part) + first
            yield period, k * np.repeat(step[at:end], part)
        at = end


def candidates(ids: np.ndarray, hashes: PrefixHashes) -> np.ndarray:
    """Distinct (start, end, period) of all stretches that the hashes call long enough."""
    n, found = len(ids), [np.zeros((0, 3), np.int64)]
    for p, x in grid(n):
        on = ids[x] == ids[x + p]
        p, x = p[on], x[on]
        # Of a long enough stretch a half or more lies on one side of its grid point.
        half = np.maximum(LEAST_WORDS - p, (LEAST_TURNS - 1) * p) >> 1
        upto, since = np.minimum(x + half, n - p), np.maximum(x - half, 0)
        on = (hashes.same(x, upto, p) & (upto == x + half)) | (hashes.same(since, x, p) & (since == x - half))
        p, x = p[on], x[on]
        if len(p):
            right = longest(n - p - x, lambda m: hashes.same(x, x + m, p))
            left = longest(x, lambda m: hashes.same(x - m, x, p))
            size = left + right + p
            on = size >= np.maximum(LEAST_WORDS, LEAST_TURNS * p)
            start = (x - left)[on]
            found.append(np.unique(np.stack([start, start + size[on], p[on]], 1), axis=0))
    return np.unique(np.concatenate(found), axis=0)


def confirmed(ids: np.ndarray, found: np.ndarray) -> np.ndarray | None:
    """One row (start, end, smallest period) per run, or null if any find isn't what the words say.

    Finds of one stretch of words differ by multiples of its smallest period: that
    one is compared word by word, for the others divisibility proves the period.
    """
    if not len(found):
        return found
    start, end, p = found.T
    loose = (start > 0) & (ids[start - 1] == ids[start - 1 + p])
    loose |= (end < len(ids)) & (ids[np.minimum(end, len(ids) - 1)] == ids[end - p])
    if loose.any():
        return None
    first = np.ones(len(found), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    least = p[np.flatnonzero(first)][np.cumsum(first) - 1]
    if (p % least).any():
        return None
    runs = found[first]
    if all(np.array_equal(ids[s : e - q], ids[s + q : e]) for s, e, q in runs):
        return runs
    return None


def find_runs(words: list[str]) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start, then period."""
    n = len(words)
    if n < LEAST_WORDS:
        return np.zeros((0, 3), np.int64)
    names: dict[str, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    base = 1_000_003
    while (runs := confirmed(ids, candidates(ids, PrefixHashes(ids, base)))) is None:
        base = base * 48_271 % _PRIME
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapse(words: list[str], runs: np.ndarray) -> str:
    """The words that no run holds after its first period, joined by one space."""
    if not len(runs):
        return " ".join(words)
    edge = np.bincount(runs[:, 0] + runs[:, 2], minlength=len(words) + 1) - np.bincount(runs[:, 1], minlength=len(words) + 1)
    return " ".join([words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, runs, collapsed.

    ``runs`` holds (start, length, period) in words of every run, by start, then
    period; ``collapsed`` is the text with each run cut down to its first period.
    Null and empty texts have no words and no runs. No row leaves its partition, so
    repeated rows and null ids need no rule; an empty table gives no rows and extra
    columns are ignored. A text is held whole by one task, its grid in chunks.
    """

    def run(ids, texts):
        sizes, runs, short = [], [], []
        for text in texts:
            words = _WORD.findall(text or "")
            found = find_runs(words)
            sizes.append(len(words))
            runs.append([{"start": s, "length": e - s, "period": q} for s, e, q in found.tolist()])
            short.append(collapse(words, found))
        return [ids, sizes, runs, short]

    rows = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), "text")
    return map_slices(rows, run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text with a period made in one document of ten, chosen and shaped by crc32 of the decimal doc_id.

    From word a = g % n on, words repeat the first 1 + (n - a) / (3 + g % 8) of them,
    where g is a tenth of the crc. A null doc_id or text stays as it is.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.array_remove(F.split(text, GAP), "")
    n = F.size(words)
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = F.floor((n - a) / (g % 8 + 3)).cast("int") + 1
    turns = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), turns)), F.lit(1), n - a)
    altered = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return F.when((h % 10 == 0) & text.isNotNull() & (n > 0), altered).otherwise(text)


def strongest(runs: Column) -> Column:
    """The run with the greatest length by period, compared as fractions; of equal ones the first."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    better = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    return F.aggregate(runs, none, lambda best, run: F.when(better(best, run), run).otherwise(best))
