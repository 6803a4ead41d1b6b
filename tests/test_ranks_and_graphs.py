"""Ranks over ranges, ordered digests, nested JSON, peeling and cycles on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from veridock.operators import graph, lineage, ranks, segments


def test_ranks_of_a_hot_group(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 40), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, id int")
    got = {r["id"]: (r["place"], r["n"]) for r in ranks.group_ranks(df, ["g"], ["o", "id"], "place", "n").collect()}
    for g in ("a", "b", None):
        mine = sorted((o, k) for x, o, k in rows if x == g)
        assert [got[k] for _, k in mine] == [(i + 1, len(mine)) for i in range(len(mine))]
    assert ranks.group_ranks(df.limit(0), ["g"], ["o"]).count() == 0


def test_siblings_link_neighbours(spark):
    df = spark.createDataFrame([("x", k, f"e{k}") for k in (3, 1, 2)] + [(None, 1, "n1"), (None, 2, "n2"), ("y", 1, "y1")], "g string, o int, id string")
    got = {tuple(r) for r in segments.siblings(df, ["g"], "o", "id").collect()}
    assert got == {(a, b, r) for x, y in (("e1", "e2"), ("e2", "e3"), ("n1", "n2")) for a, b, r in ((x, y, "next_sibling"), (y, x, "previous_sibling"))}


def test_ordered_digest_depends_on_order_and_not_on_partitions(spark):
    rows = [(k, f"t{k % 7}") for k in range(5000)]

    def digest(rows, parts=3):
        return ranks.ordered_digest(spark.createDataFrame(rows, "k int, t string").repartition(parts), ["k"], F.col("t")).first()

    first = digest(rows)
    assert first == digest(rows[::-1], 11) and first["n_rows"] == 5000
    assert digest([(k, rows[4999 - k][1]) for k in range(5000)])["digest"] != first["digest"]
    assert digest(rows[:-1])["digest"] != first["digest"] != digest([*rows, (9, None)])["digest"]
    assert digest([])["n_rows"] == 0 and len(digest([])["digest"]) == 64 and digest(rows[:1])["n_rows"] == 1


def by_hand(value, path="$"):
    if isinstance(value, dict) and value:
        return {p: v for k, x in value.items() for p, v in by_hand(x, f"{path}.{k}" if k.isidentifier() else f"{path}[{json.dumps(k)}]").items()}
    if isinstance(value, list) and value:
        return {p: v for k, x in enumerate(value) for p, v in by_hand(x, f"{path}[{k}]").items()}
    return {path: value}


def test_json_leaves_at_any_depth(spark):
    deep = {"a": [1, [2, [3, {"b": []}]], {}], "c": {"d e": None, "f": "x"}, "g": 1.5, "h": True}
    for _ in range(20):
        deep = {"n": [deep, "s"]}
    rows = [(1, json.dumps(deep)), (2, "[]"), (3, "7"), (4, "{oops"), (5, None), (6, '{"a": {}}')]
    got = lineage.json_paths(spark.createDataFrame(rows, "id int, j string"), "id", "j").collect()
    want = by_hand(deep)
    assert {r["path"]: json.loads(r["value"]) for r in got if r["id"] == 1} == want
    rest = {(r["id"], r["path"], r["type"], r["value"]) for r in got if r["id"] != 1}
    assert rest == {(2, "$", "ARRAY", "[]"), (3, "$", "BIGINT", "7"), (4, "$", "INVALID", "{oops"), (6, "$.a", "OBJECT", "{}")}


def test_json_differences_name_path_and_kind(spark):
    def table(*rows):
        return spark.createDataFrame(list(rows), "id int, j string")

    left = table((1, '{"a": [1, 2], "b": {"c": 1}}'), (2, '{"x": 1}'))
    right = table((1, '{"a": [1, 3, 4], "b": {"c": "1"}}'), (3, '{"x": 1}'))
    got = {(r["id"], r["path"], r["kind"]) for r in lineage.json_differences(left, right, "id", "j").collect()}
    assert got == {(1, "$.a[1]", "CHANGED"), (1, "$.a[2]", "ADDED"), (1, "$.b.c", "TYPE_CHANGED"), (2, "$.x", "REMOVED"), (3, "$.x", "ADDED")}


def reach(edges, start):
    seen, todo = set(), [start]
    while todo:
        for a, b in edges:
            if a == todo[-1] and b not in seen:
                seen.add(b)
                todo.insert(0, b)
        todo.pop()
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_peeling_and_cycles_are_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = list({(rng.randint(1, 16), rng.randint(1, 16)) for _ in range(18)})
    es, ns = spark.createDataFrame(edges, "source int, target int"), spark.createDataFrame([(k,) for k in range(1, 17)], "node int")
    reached = {k: reach(edges, k) for k in range(1, 17)}
    loops = {k for k in reached if k in reached[k]}
    want = {k: min(j for j in loops if j in reached[k] and k in reached[j]) for k in loops}
    assert {r["node"]: r["cycle"] for r in graph.cycles(es, ns).collect()} == want
    level = {}
    while True:
        free = [k for k in range(1, 17) if k not in level and all(a in level for a, b in edges if b == k)]
        if not free:
            break
        level |= {k: max(level.values(), default=0) + 1 for k in free}
    assert {r["node"]: r["level"] for r in graph.peel(es, ns).collect()} == {k: level.get(k) for k in range(1, 17)}


def test_a_deep_traversal_keeps_its_plan_small(spark):
    links = spark.createDataFrame([(f"n{a}", f"n{2 * a + b}", "parent") for a in range(1, 8) for b in (0, 1)], "source string, target string, relation string")
    known = spark.createDataFrame([(f"n{k}", True, None) for k in range(1, 16)], "node string, is_known boolean, stale string")
    got = graph.traverse(spark.createDataFrame([(1, "n1")], "query int, node string"), links, known, depth=3, max_nodes=20)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") < 5
    assert {(r["target"], r["depth"]) for r in got.collect()} == {(f"n{k}", k.bit_length() - 1) for k in range(2, 16)}
