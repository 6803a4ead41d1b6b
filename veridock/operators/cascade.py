"""Search with fallbacks: every query falls through stages until one has hits, all over the stored index.

What a stage asks is a table of attempts, derived from the queries with column
functions. A stage looks its attempts up by term, all open queries at once;
queries that have an accepted hit leave by an anti-join, so nothing is asked in vain.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridock.functions.numbers import decimal_text
from veridock.functions.text import collapse, sub_queries, tokens
from veridock.operators import inverted_index
from veridock.operators.inverted_index import Index
from veridock.sources.session import ensure_checkpoint_dir

#: Stages in order.
STAGES = (
    "EXACT_CLAUSE", "PHRASE", "TOKEN_AND", "TOKEN_PREFIX", "FACT_DECONTAMINATED", "APPROVED_ALIAS", "LEGAL_COMPOUND_DECOMPOSITION", "CORE_TOKEN_AND", "HEADING_SCOPED",
)
#: How a stage searches the index; EXACT_CLAUSE is an equi-join with labels.
KIND = {
    "PHRASE": "phrase", "TOKEN_AND": "tokens", "TOKEN_PREFIX": "prefixes", "FACT_DECONTAMINATED": "prefixes", "APPROVED_ALIAS": "tokens",
    "LEGAL_COMPOUND_DECOMPOSITION": "prefixes", "CORE_TOKEN_AND": "prefixes", "HEADING_SCOPED": "prefixes",
}
#: Approved aliases, words of mere intent, endings of words that a shorter query keeps, words and endings that a heading search ignores.
ALIASES = (("최소 면적", "대지면적"), ("주차장 설치기준", "주차기준"), ("주차기준", "주차장 설치기준"), ("용적률", "기본용적률"))
INTENT = "기준 거리 요건 절차 검토 여부 가능 가능여부 최소 최대 적용 완화 추가".split()
KEPT_ENDINGS = "계획 심의 협의 허가 인가 승인 신고 등록 위원회".split()
HEADING_STOP = "기준 검토 검색 검색한다 검색하는 검색한다. 관련 무엇인가 무엇인가? 어떤 정하는 정한다 조항 조항을 법령 조례 지침 법령·조례·지침·기준 여부 적용 최소 최대 추가".split()
PARTICLES = "에서 으로 에게 의 을 를 은 는 이 가 에 로 과 와 도 만".split()
UNIT_KEYS = {
    "m": "length_m", "미터": "length_m", "m2": "area_m2", "㎡": "area_m2", "제곱미터": "area_m2", "m3": "volume_m3", "㎥": "volume_m3", "%": "percent", "퍼센트": "percent",
    "km": "length_km", "mm": "length_mm", "cm": "length_cm",
}
MAX_CORE = 10
_AMOUNT = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
_UNIT = "(" + "|".join(sorted(UNIT_KEYS, key=len, reverse=True)) + ")"
_EDGES = ".,!?;:()[]{}<>\\\"'“”‘’"


def clean(word: Column) -> Column:
    """A word without punctuation at its ends."""
    return F.btrim(word, F.lit(_EDGES))


def amount_key(word: Column) -> Column:
    """Number and kind of unit of a word that is an amount, the same for all spellings; else null."""
    low = F.regexp_replace(F.lower(word), "m²", "m2")
    whole = rf"^{_AMOUNT}{_UNIT}?$"
    number = decimal_text(F.regexp_replace(F.regexp_extract(low, whole, 1), ",", "").try_cast("decimal(28,8)"))
    units = F.create_map(*[F.lit(x) for pair in UNIT_KEYS.items() for x in pair])
    unit = F.regexp_extract(low, whole, 2)
    return F.when(low.rlike(whole), F.concat(number, F.lit(":"), F.coalesce(units[unit], unit)))


def amounts(texts: Column) -> Column:
    """Keys of all amounts in an array of texts, also where a space stands before the unit."""
    apart = F.transform(texts, lambda t: F.regexp_extract_all(F.regexp_replace(F.lower(t), "m²", "m2"), F.lit(rf"(?<![0-9,]){_AMOUNT}\s*{_UNIT}(?![a-z0-9])"), 0))
    words = F.transform(texts, lambda t: F.transform(F.split(collapse(t), " "), clean))
    found = F.concat(F.transform(F.flatten(apart), lambda x: F.regexp_replace(x, r"\s", "")), F.flatten(words))
    return F.array_distinct(F.filter(F.transform(found, amount_key), lambda k: k.isNotNull()))


def _some(test: Column, value: Column) -> Column:
    """One value where the test holds, else none."""
    return F.when(test, F.array(value)).otherwise(F.array().cast("array<string>"))


def _replaced(base: Column, source: str, replacement: str) -> Column:
    """The first place of some words replaced by others; null where they don't stand."""
    halves = F.split(F.concat(F.lit(" "), base, F.lit(" ")), f" {source} ", 2)
    return F.when(F.size(halves) == 2, F.btrim(F.concat_ws(" ", halves[0], F.lit(replacement), halves[1])))


def attempts(queries: DataFrame) -> DataFrame:
    """q, ord, stage, derived, terms: all that may be asked for queries (q, text, facts), in order and without repeats.

    ``facts`` are texts of what is known of the case: their amounts are taken out of
    a query, as a rule isn't found by the case's own numbers, while other amounts and
    words of procedure stay in every shorter query.
    """
    norm = queries.select("q", collapse(F.col("text")).alias("text"), F.coalesce("facts", F.array().cast("array<string>")).alias("facts"))
    words = norm.withColumn("ws", F.split("text", " ")).withColumn("known", amounts(F.col("facts")))
    kept = F.filter("ws", lambda w: ~F.coalesce(F.array_contains(F.col("known"), amount_key(clean(w))), F.lit(False)))
    words = words.withColumn("kept", kept)
    fewer = (F.size("kept") >= 2) & (F.size("kept") < F.size("ws"))
    words = words.withColumn("plain", F.when(fewer, F.array_join("kept", " ")))
    numeric = F.filter(F.transform("ws", clean), lambda w: amount_key(w).isNotNull() & ~F.coalesce(F.array_contains(F.col("known"), amount_key(w)), F.lit(False)))
    procedure = F.filter(F.transform("ws", clean), lambda w: reduce(lambda a, b: a | b, [w.endswith(e) for e in KEPT_ENDINGS]))
    words = words.withColumn("numeric", numeric).withColumn("procedure", procedure)
    bases = F.array_distinct(F.array_compact(F.array("text", "plain")))
    words = words.withColumn("bases", bases)
    aliases = F.array_distinct(F.array_compact(F.flatten(F.transform("bases", lambda b: F.array(*[_replaced(b, s, r) for s, r in ALIASES])))))
    content = F.transform("bases", lambda b: F.filter(F.split(b, " "), lambda w: ~w.isin(INTENT)))
    compounds = F.array_except(F.transform(F.filter(content, lambda c: F.size(c) >= 2), lambda c: F.array_join(c, " ")), F.col("bases"))
    words = words.withColumn("compounds", compounds).withColumn("aliases", aliases)
    required = F.array_union("numeric", "procedure")
    shorter = F.flatten(F.transform(F.array_distinct(F.concat("bases", "compounds")), lambda b: F.when(F.size(F.split(b, " ")) > 2, sub_queries(F.split(b, " "), 1 << 20)).otherwise(F.array().cast("array<string>"))))
    cores = F.filter(F.array_distinct(shorter), lambda s: F.size(F.array_except(F.col("required"), F.transform(F.split(s, " "), clean))) == 0)
    words = words.withColumn("required", required)
    words = words.withColumn("cores", F.slice(cores, 1, MAX_CORE))
    stripped = F.filter(F.transform(F.split(F.coalesce("plain", "text"), " "), clean), lambda w: ~w.isin(HEADING_STOP))
    particle = "(?<=..)(?:" + "|".join(PARTICLES) + ")$"
    heading = F.filter(F.transform(stripped, lambda w: F.regexp_replace(w, particle, "")), lambda w: (w != "") & ~w.isin(HEADING_STOP))
    nothing = F.array().cast("array<string>")

    def asked(stage: str, derived: Column) -> Column:
        return F.transform(derived, lambda d: F.struct(F.lit(stage).alias("stage"), d.alias("derived")))

    whole = F.array("text")
    table = F.concat(
        *[asked(s, whole) for s in ("EXACT_CLAUSE", "PHRASE", "TOKEN_AND", "TOKEN_PREFIX")],
        asked("FACT_DECONTAMINATED", _some(F.col("plain").isNotNull(), F.col("plain"))),
        asked("APPROVED_ALIAS", F.col("aliases")),
        asked("LEGAL_COMPOUND_DECOMPOSITION", F.col("compounds")),
        asked("CORE_TOKEN_AND", F.col("cores")),
        asked("HEADING_SCOPED", F.when((F.size("numeric") == 0) & (F.size(heading) > 0), F.array(F.array_join(heading, " "))).otherwise(nothing)),
    )
    flat = words.where("text <> ''").select("q", F.posexplode(table).alias("ord", "a"))
    return flat.select("q", "ord", "a.stage", "a.derived", tokens(F.col("a.derived")).alias("terms"))


def fall_through(index: Index, queries: DataFrame, k: int, labels: DataFrame | None = None, headings: DataFrame | None = None, accept: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Hits and trace of queries (q, text, facts).

    Hits are (q, stage, derived, key, score, rank) of the first attempt that has an
    accepted one. The trace holds (q, ord, stage, derived, hit_count) of every attempt
    up to it, hits counted after acceptance. ``labels`` (key, label) serve the exact
    stage, ``headings`` (key, heading) rank the last one by words of the query in the
    heading, ``accept`` gets (q, key, ...) and returns the rows it takes. A round cuts
    its lineage in the shared folder.
    """
    ensure_checkpoint_dir(queries.sparkSession)
    todo = attempts(queries).checkpoint()
    hits, traces, answered = [], [], None
    for stage in STAGES:
        open_now = todo.where(F.col("stage") == stage)
        # A stage asks for its attempts in several places.
        open_now = open_now if answered is None else open_now.join(answered, "q", "left_anti").checkpoint()
        if stage == "EXACT_CLAUSE":
            if labels is None:
                continue
            found = open_now.join(labels.select("key", collapse(F.col("label")).alias("derived")), "derived").select("q", "ord", "key", F.lit(1.0).alias("score"))
        else:
            asked = open_now.where(F.size("terms") > 0).select(F.struct("q", "ord").alias("q"), "terms")
            if asked.isEmpty():
                continue
            # More than k are fetched, as acceptance and headings choose among them.
            found = inverted_index.matches(index, asked, KIND[stage], max(16 * k, 100)).select("q.q", "q.ord", "key", "score")
            if stage == "HEADING_SCOPED" and headings is not None:
                held = F.size(F.array_intersect("terms", tokens(F.col("heading"))))
                found = found.join(open_now.select("q", "ord", "terms"), ["q", "ord"]).join(headings, "key", "left").select("q", "ord", "key", F.coalesce(held, F.lit(0)).cast("double").alias("score"))
        found = found if accept is None else accept(found)
        first = found.groupBy("q").agg(F.min("ord").alias("ord"))
        best = found.join(first, ["q", "ord"])
        best = inverted_index.ranked(best.select(F.struct("q", "ord").alias("q"), "key", "score"), k).select("q.q", "q.ord", "key", "score", "rank")
        best = best.join(open_now.select("q", "ord", "derived"), ["q", "ord"]).select("q", "ord", F.lit(stage).alias("stage"), "derived", "key", "score", "rank").checkpoint()
        hits.append(best.drop("ord"))
        counts = best.groupBy("q", "ord").agg(F.count(F.lit(1)).alias("hit_count"))
        until = counts.select("q", F.col("ord").alias("upto"))
        traces.append(open_now.join(until, "q", "left").where("upto IS NULL OR ord <= upto").join(counts, ["q", "ord"], "left").select("q", "ord", "stage", "derived", F.coalesce("hit_count", F.lit(0)).alias("hit_count")))
        done = best.select("q").distinct()
        answered = done if answered is None else answered.union(done)
    return reduce(DataFrame.unionByName, hits), reduce(DataFrame.unionByName, traces)
