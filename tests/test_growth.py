"""What a step holds or sends grows no faster than its tables: read from plans, on tables of any size."""

import os

import pytest
from pyspark.sql import functions as F

from veridock.operators import clauses, inverted_index
from veridock.plans import legal, review
from veridock.sources import ingest

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled(spark, run):
    """Rows that a run writes to shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in map(stages.apply, range(stages.size()))}

    before = written()
    run()
    return sum(n for k, n in written().items() if k not in before)


@needs_tables
@pytest.mark.parametrize("name", ["facet_comparisons", "approval_codes"])
def test_no_table_of_issues_or_rules_is_broadcast(spark, name):
    assert "BroadcastExchange" not in plan(legal.QUERIES[name](spark, SF))


@pytest.fixture(scope="module")
def common_words(spark, tmp_path_factory):
    """An index of 400 documents that all hold the same words."""
    docs = spark.range(400).selectExpr("id AS key", "concat('alpha beta gamma n', id) AS text")
    return inverted_index.build(docs, str(tmp_path_factory.mktemp("growth") / "i"))


@pytest.mark.parametrize("kind", inverted_index.KINDS)
def test_postings_are_shuffled_once_for_all_queries(spark, common_words, kind):
    asked = spark.range(50).selectExpr("id AS q", "array('alpha', 'beta') AS terms")
    assert shuffled(spark, lambda: inverted_index.matches(common_words, asked, kind, 3).collect()) < 50 * 400


def test_top_k_shuffles_postings_once_for_all_queries(spark, common_words):
    asked = spark.range(50).selectExpr("id AS q", "array('alpha', 'beta') AS terms")
    assert shuffled(spark, lambda: inverted_index.top_k(common_words, asked, 3).collect()) < 5_000


def test_build_shuffles_texts_not_tokens(spark, tmp_path):
    docs = spark.range(20).selectExpr("id AS key", "array_join(transform(sequence(1, 500), x -> concat('w', x)), ' ') AS text")
    assert shuffled(spark, lambda: inverted_index.build(docs, str(tmp_path / "i"))) < 5_000


def test_anchors_are_found_in_arrow_batches(spark):
    from veridock.functions.text import folded, match_text
    from veridock.operators import relevance

    said = [" A\x1cB 　c ", "Ｓtraße\x85x", "", " ﬁ\t\n"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "k int, t string")
    assert [r[0] for r in rows.orderBy("k").select(match_text(rows["t"])).collect()] == [folded(t) for t in said]
    assert "MapInPandas" not in plan(relevance.anchor_hits(rows, "k", "t", spark.createDataFrame([("b c",)], "anchor string")))


@pytest.mark.parametrize("kind, words", [("prefixes", "'n'"), ("phrase", "'alpha', 'beta'")])
def test_a_search_meets_its_blocks_once(spark, tmp_path, kind, words):
    docs = spark.range(1000).selectExpr("id AS key", "concat('alpha beta n', id) AS text")
    index = inverted_index.build(docs, str(tmp_path / "i"))
    asked = spark.range(1).selectExpr("id AS q", f"array({words}) AS terms")
    # A prefix's postings are dealt as blocks and as they were summed and kept; names of its terms are gathered three times.
    most = 5_100 if kind == "prefixes" else 30
    assert shuffled(spark, lambda: inverted_index.matches(index, asked, kind, 3).collect()) < most


def test_phrases_whose_words_repeat_or_cross_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a a b a a"), (2, "b a"), (3, "a b a b a"), (4, ""), (5, "a")], "key long, text string")
    index = inverted_index.build(docs, str(tmp_path / "i"))
    asked = spark.createDataFrame([("aa", ["a", "a"]), ("bab", ["b", "a", "b"]), ("ababa", list("ababa")), ("b", ["b"]), ("bb", ["b", "b"])], "q string, terms array<string>")
    found = inverted_index.phrases(index, asked.selectExpr("q", "size(terms) AS n_slots", "posexplode(terms) AS (slot, word)"))
    assert {(r["q"], r["key"], r["dl"], r["f"]) for r in found.collect()} == {("aa", 1, 5, 2), ("bab", 3, 5, 1), ("ababa", 3, 5, 1), ("b", 1, 5, 1), ("b", 2, 2, 1), ("b", 3, 5, 2)}


@needs_tables
def test_channels_read_texts_once(spark):
    """Statistics and ranks come from the counts that were kept."""
    assert "documents.parquet" not in plan(review.QUERIES["reciprocal_rank_fusion"](spark, SF))


def test_lines_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(clauses, "LINES_A_TASK", 100, raising=False)
    lines = spark.range(5000).selectExpr("id AS revision", "1L AS pos", "'e' AS element", "'t' AS text")
    dealt = clauses.by_revision(lines)
    assert dealt.rdd.getNumPartitions() == 50
    assert plan(clauses.derive_clauses(dealt.distinct())).count("Exchange") == 1


def test_links_to_one_end_are_no_single_task(spark):
    links = spark.range(2000).selectExpr("concat('k', id) AS id", "CASE WHEN id = 7 THEN NULL WHEN id % 2 = 0 THEN 'd' ELSE 'nowhere' END AS target_id")
    known = spark.createDataFrame([("d",), ("d",), (None,)], "id string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lost = ingest._unknown(links, "links", "target_id", known, shared=True)
        sizes = [r["count"] for r in lost.groupBy(F.spark_partition_id()).count().collect()]
        ids = {r["id"] for r in lost.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ids == {f"k{i}" for i in range(1, 2000, 2)}
    assert sum(sizes) == 1000 and max(sizes) < 500
