"""Every registered query of the engine against DuckDB on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from veridock.plans import audit, legal, relational, retrieval, review

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {**relational.QUERIES, **review.QUERIES, **audit.QUERIES, **retrieval.QUERIES, **legal.QUERIES}
ORACLE = {**relational.ORACLE, **review.ORACLE, **audit.ORACLE, **retrieval.ORACLE, **legal.ORACLE}


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, list):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert Counter(tuple(norm(r[i]) for i in at) for r in rel.fetchall()) == got


@pytest.mark.skipif(not os.path.isdir(SF) or not set(QUERIES) - set(ORACLE), reason="driver tables are not here, or every query has SQL")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
