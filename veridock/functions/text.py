"""Text functions: normal forms, tokens, query variants. All but Unicode normal forms stay in the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what separates tokens once text is lower-cased; anything outside ASCII belongs to tokens.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def collapse(col: Column) -> Column:
    """Runs of Unicode white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def _form(name: str):
    @F.pandas_udf("string")
    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize(name, v))

    return apply


def normalize_text(col: Column) -> Column:
    """NFC and collapsed white space."""
    return collapse(_form("NFC")(col))


def compatibility_text(col: Column) -> Column:
    """NFKC and collapsed white space."""
    return collapse(_form("NFKC")(col))


def match_text(col: Column) -> Column:
    """NFKC, collapsed, case-folded."""

    @F.pandas_udf("string")
    def fold(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else v.casefold())

    return fold(compatibility_text(col))


#: What Java's (?U)\\s takes: Unicode white space, without the separators of files and records.
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def folded(text: str) -> str:
    """``match_text`` of one text, for functions that run in Python anyway."""
    return _SPACES.sub(" ", unicodedata.normalize("NFKC", text)).strip(" ").casefold()


def tokens(col: Column) -> Column:
    """Lower-case tokens in order; null counts as empty."""
    return F.array_remove(F.split(F.lower(F.coalesce(col, F.lit(""))), SEPARATORS), "")


def token_text(col: Column) -> Column:
    """Tokens between single spaces with a space at both ends: phrases are then plain substrings."""
    return F.concat(F.lit(" "), F.array_join(tokens(col), " "), F.lit(" "))


def runs_of(words: Column, n: int, separator: str) -> Column:
    """Every run of n adjacent tokens, joined."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
    return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), separator))).otherwise(F.array())


def compounds(words: Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """Adjacent tokens written as one, for every given size, in order and without repeats."""
    return F.array_distinct(F.flatten(F.array(*[runs_of(words, n, "") for n in sizes])))


def sub_queries(words: Column, limit: int = 10) -> Column:
    """Shorter queries: each token left out once, then runs of three and of two; at most ``limit``."""
    n = F.size(words)
    left_out = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.concat(F.slice(words, 1, i - 1), F.slice(words, i + 1, n)), " "))).otherwise(F.array())
    runs = [F.when(n > k, runs_of(words, k, " ")).otherwise(F.array()) for k in (3, 2)]
    return F.slice(F.array_distinct(F.flatten(F.array(left_out, *runs))), 1, limit)


def heading_slug(col: Column) -> Column:
    """Heading to anchor: lower case, punctuation dropped, spaces to hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col)), r"[^\p{L}\p{N}\s_-]", ""), r"\s", "-")


def strip_suffix(col: Column, suffixes: list[str], stem: int = 2) -> Column:
    """Drop the longest listed suffix that leaves a stem of at least ``stem`` characters."""
    out = col
    for s in sorted(suffixes, key=len):
        out = F.when(col.endswith(s) & (F.length(col) - len(s) >= stem), F.substring(col, F.lit(1), F.length(col) - len(s))).otherwise(out)
    return out


def grouped_number(col: Column) -> Column:
    """Plain and thousands-grouped spelling of an integer text."""
    plain = F.regexp_replace(col, ",", "")
    return F.array_distinct(F.array(plain, F.format_number(plain.cast("long"), 0)))
