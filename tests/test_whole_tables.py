"""Queries read whole tables: ids and rows that earlier versions left out must come through."""

import os

import pytest

from veridock.plans import relational, review

SF = "/root/testdata/sf0.01"
QUERIES = {**relational.QUERIES, **review.QUERIES}
#: Query, its column of ids, and an id that lies beyond all former limits.
BEYOND = {"claim_validation": "claim_id", "collected_lineage": "o_orderkey", "frontage_ratio": "l_orderkey", "conditional_threshold": "l_orderkey", "page_local_ordinal": "l_orderkey", "box_normalisation": "l_orderkey"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(BEYOND))
def test_beyond_the_prefix(spark, name):
    assert QUERIES[name](spark, SF).where(f"{BEYOND[name]} > 14000").count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_beyond_the_filter(spark):
    assert QUERIES["bfs_budgeted"](spark, SF).where("query % 50 <> 0").count() > 0
    assert QUERIES["json_diff"](spark, SF).where("event_id % 3 <> 0").count() > 0
    other = spark.read.parquet(f"{SF}/documents.parquet").where("lang <> 'en'").select("doc_id")
    assert QUERIES["clause_segmentation"](spark, SF).join(other, "doc_id").count() > 0


def test_staleness_follows_late_events(spark, tmp_path):
    rows = [(100, 7), (7, 900), (900, 901), (901, 7), (5, 6)]
    spark.createDataFrame([(u, f'{{"k": {k}}}') for u, k in rows], "user_id long, props string").write.parquet(str(tmp_path / "events.parquet"))
    assert {r.node for r in QUERIES["transitive_staleness"](spark, str(tmp_path)).collect()} == {100, 7, 900, 901}


def test_every_line_is_counted(spark, tmp_path):
    spark.createDataFrame([(k, "A", "F", float(k)) for k in (1, 499, 500, 70_000)], "l_orderkey long, l_returnflag string, l_linestatus string, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [tuple(r) for r in QUERIES["conflict_groups"](spark, str(tmp_path)).collect()] == [("A", "F", 4, 4, True)]
