"""Closures of long chains are whole, or an error."""

import pytest

from veridock.operators import graph
from veridock.sources.session import ensure_checkpoint_dir


def test_closure_of_a_long_chain(spark):
    ensure_checkpoint_dir(spark)
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(30, 7), (50, 51), (9, None)], "source int, target int")
    starts = spark.createDataFrame([(0,)], "node int")
    got = [r["node"] for r in graph.closure(edges, starts).collect()]
    assert sorted(got, key=lambda n: -1 if n is None else n) == [None, *range(31)]
    with pytest.raises(ValueError):
        graph.closure(edges, starts, rounds=5)


def test_a_bound_that_suffices(spark):
    ensure_checkpoint_dir(spark)
    edges = spark.createDataFrame([(1, 2), (2, 3)], "source int, target int")
    assert sorted(r["node"] for r in graph.closure(edges, spark.createDataFrame([(1,)], "node int"), rounds=2).collect()) == [1, 2, 3]
