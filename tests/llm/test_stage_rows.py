"""Pipeline stages: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns of any name."""

from collections import Counter

import pytest

import corpus_pipeline
from veridock.llm.decontaminate import without_contaminated
from veridock.llm.line_dedup import cut_repeated_runs
from veridock.llm.near_dup import one_of_each_class
from veridock.llm.toxicity import without_toxic

ITEM = "one two three four five six seven eight nine ten eleven"
PASSAGE = "\n".join(f"line {k} of a passage that some documents share word for word" for k in range(8))
ROWS = [
    (1, None),
    (2, ""),
    (3, f"start\n{PASSAGE}\nend"),
    (4, PASSAGE),
    (5, f"before {ITEM} after"),
    (6, "quite another text of more than five words"),
    (6, "quite another text of more than five words"),
    (6, "the same id with a different text than before"),
    (7, "some vile insult stands here"),
    (None, "a row without an id and with a text"),
    (8, "long " * 50_000),
]
NAMES = ["doc_id", "text", "TEXT", "Doc_Id", "key_", "runs", "doc", "c0", "salt_", "source", "source"]


def rows_of(spark, rows):
    """More columns than wanted: names that differ in case only, repeat, or are those of helper columns."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", *[f"'{n}{k}' x{k}" for k, n in enumerate(NAMES[2:])]).toDF(*NAMES)


def stages(spark):
    labels = spark.createDataFrame([(k, int(k == 7)) for k in range(1, 9)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string")
    return {
        "toxicity": lambda d: without_toxic(d, labels),
        "line_dedup": cut_repeated_runs,
        "near_dedup": one_of_each_class,
        "decontamination": lambda d: without_contaminated(d, bench),
    }


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "near_dedup", "decontamination"])
def test_stages_give_rows_back_whole(spark, name):
    stage = stages(spark)[name]
    got = stage(rows_of(spark, ROWS))
    assert got.columns == NAMES
    got = got.collect()
    assert all(tuple(r)[2:] == tuple(f"{n}{k}" for k, n in enumerate(NAMES[2:])) for r in got)
    left = Counter((r[0], r[1]) for r in got)
    if name == "toxicity":
        # Two of eight labelled rows don't make a model that is sure of anything else.
        assert set(left) <= set(ROWS) and left[None, ROWS[9][1]] == 1
    elif name == "line_dedup":
        assert left == Counter((i, "" if i == 4 else t) for i, t in ROWS)
    elif name == "near_dedup":
        # Texts without words are one class, the passage with and without two more lines another; a repeated row stays once.
        assert left == Counter({r: 1 for r in ROWS if r[0] not in (2, 4)})
    else:
        assert left == Counter(r for r in ROWS if r[0] != 5)
    empty = stage(rows_of(spark, []))
    assert empty.columns == NAMES and empty.count() == 0


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "tokenization"]
