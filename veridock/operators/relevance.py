"""Relevance of found clauses: anchors that a query and a clause name, and a decision with reasons.

All anchors are looked for at once, by one automaton that is broadcast if its size,
measured first, allows it; else anchors and texts are brought together by grams.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridock.functions.text import folded, match_text

#: Subjects that exclude each other, and what a clause must name if a query names the trigger.
SUBJECT_GROUPS = (("역세권", "간선도로변"),)
REQUIRED_ANCHORS = ((("최소", "면적"), (("최소", "면적"), ("최소면적",), ("대지면적",))), (("산업부지", "확보비율"), (("산업부지", "확보비율"),)))
REQUIRED_INTENTS = ((("공공기여", "산정"), (("공공기여", "산정"), ("공공기여", "비율"), ("공공기여", "면적"), ("공공기여", "가격"), ("공공기여", "부담"))),)
#: Bounds of an automaton that is broadcast.
MAX_ANCHORS, MAX_ANCHOR_BYTES = 200_000, 16 * 1024 * 1024
#: Characters by which anchors and texts meet where there are more.
GRAM = 3


def anchor_hits(texts: DataFrame, key: str, text: str, anchors: DataFrame) -> DataFrame:
    """key, anchor: the anchors (column anchor) that stand anywhere in each text, both in normal form; each once. Null texts have none."""
    wanted = anchors.select(match_text(F.col("anchor")).alias("anchor")).where("anchor <> ''").distinct()
    count, size = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("anchor")), F.lit(0))).first()
    if count > MAX_ANCHORS or size > MAX_ANCHOR_BYTES:
        return _by_grams(texts.select(key, match_text(F.col(text)).alias("t")).where("t IS NOT NULL"), key, wanted)
    rows = texts.select(key, F.col(text).alias("t")).where("t IS NOT NULL")
    names = sorted(r["anchor"] for r in wanted.collect())
    shared = texts.sparkSession.sparkContext.broadcast(names)

    def find(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for name in shared.value:
            automaton.add_word(name, name)
        if shared.value:
            automaton.make_automaton()
        # Texts are brought into normal form one by one: a batch is held once, as Arrow has it.
        for batch in batches:
            found = [sorted({name for _, name in automaton.iter(folded(t.as_py()))}) if shared.value else [] for t in batch["t"]]
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(found, pa.list_(pa.string()))], [key, "anchor"])

    schema = f"{key} {rows.schema[key].dataType.simpleString()}, anchor array<string>"
    return rows.mapInArrow(find, schema).select(key, F.explode("anchor").alias("anchor"))


def _by_grams(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """An equi-join on an anchor's first characters; texts give all their grams of these lengths."""
    def grams(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - n + 1, F.lit(1))), lambda i: F.substring("t", i, F.lit(n)))

    heads = wanted.select("anchor", F.substring("anchor", 1, GRAM).alias("gram"))
    places = rows.select(key, "t", F.explode(F.array_distinct(F.flatten(F.array(*[grams(n) for n in range(1, GRAM + 1)])))).alias("gram"))
    return places.join(heads, "gram").where(F.col("t").contains(F.col("anchor"))).select(key, "anchor").distinct()


def rule_anchors(groups=SUBJECT_GROUPS, *rules) -> list[str]:
    """All anchors that groups and rules name."""
    names = {a for g in groups for a in g}
    for rule in rules or (REQUIRED_ANCHORS, REQUIRED_INTENTS):
        names |= {a for trigger, alternatives in rule for part in (trigger, *alternatives) for a in part}
    return sorted(names)


def _holds(found: Column, names: Sequence[str]) -> Column:
    return F.size(F.array_intersect(found, F.array(*map(F.lit, names)))) == len(set(names))


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def decision(issue: Column, request: Column, clause: Column, titled: Column, groups=SUBJECT_GROUPS, anchors=REQUIRED_ANCHORS, intents=REQUIRED_INTENTS) -> Column:
    """Struct accepted, codes from the anchors (arrays) of the issue with its request, of the request alone, and of the clause.

    A clause is refused if it names another subject of a group and none that was
    asked for, or lacks every alternative of an anchor or intent that the request
    names. ``titled``: the clause's title stands in the question.
    """
    def names(found: Column, group: Sequence[str]) -> Column:
        return F.array_intersect(found, F.array(*map(F.lit, group)))

    conflict = _any([(F.size(names(issue, g)) > 0) & (F.size(names(clause, g)) > 0) & ~F.arrays_overlap(names(issue, g), names(clause, g)) for g in groups])
    lacks = [_any([_holds(request, trigger) & ~_any([_holds(clause, a) for a in alternatives]) for trigger, alternatives in rules]) for rules in (anchors, intents)]
    subject = _any([F.arrays_overlap(names(issue, g), names(clause, g)) for g in groups])
    reasons = F.array_compact(F.array(F.when(subject, "ACCEPT_SUBJECT_MATCH"), F.when(titled, "ACCEPT_SECTION_MATCH")))
    codes = (
        F.when(conflict, F.array(F.lit("REJECT_SUBJECT_CONFLICT"))).when(lacks[0], F.array(F.lit("REJECT_REQUIRED_ANCHOR_MISSING"))).when(lacks[1], F.array(F.lit("RETRIEVAL_RELEVANCE_INSUFFICIENT")))
        .when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("ACCEPT_NO_DETERMINISTIC_CONFLICT")))
    )
    return F.struct(codes[0].startswith("ACCEPT").alias("accepted"), codes.alias("codes"))


def judge(pairs: DataFrame, queries: DataFrame, clauses: DataFrame, groups=SUBJECT_GROUPS, anchors=REQUIRED_ANCHORS, intents=REQUIRED_INTENTS) -> DataFrame:
    """q, key, accepted, codes of pairs (q, key), with queries (q, question, text) and clauses (key, title, text). Every text is searched once, however many pairs it is in."""
    spark = pairs.sparkSession
    wanted = spark.createDataFrame([(a,) for a in rule_anchors(groups, anchors, intents)], "anchor string")

    def named(rows: DataFrame, key: str, text: Column, name: str) -> DataFrame:
        return anchor_hits(rows.select(key, text.alias("__t")), key, "__t", wanted).groupBy(key).agg(F.sort_array(F.collect_set("anchor")).alias(name))

    none = F.array().cast("array<string>")
    asked = queries.select("q", match_text(F.concat_ws(" ", "question", "text")).alias("said"))
    asked = asked.join(named(queries, "q", F.concat_ws(" ", "question", "text"), "issue"), "q", "left").join(named(queries, "q", F.col("text"), "request"), "q", "left")
    held = clauses.select("key", match_text(F.col("title")).alias("heading")).join(named(clauses, "key", F.concat_ws(" ", "title", "text"), "clause"), "key", "left")
    both = pairs.select("q", "key").join(asked, "q").join(held, "key")
    titled = F.coalesce((F.col("heading") != "") & F.col("said").contains(F.col("heading")), F.lit(False))
    made = decision(F.coalesce("issue", none), F.coalesce("request", none), F.coalesce("clause", none), titled, groups, anchors, intents)
    return both.select("q", "key", made.alias("d")).select("q", "key", "d.accepted", "d.codes")
