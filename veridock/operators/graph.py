"""Graphs as edge tables: budgeted traversal, closure, cycles, impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridock.sources.session import ensure_checkpoint_dir

#: Order of relation types in a traversal.
RELATION_PRIORITY = {
    "exception": 0, "parent": 1, "next_sibling": 2, "previous_sibling": 2, "cited_clause": 3, "rule_source": 4,
    "source_not_ingested": 5, "reference_target_missing": 6, "table": 7, "visual": 8,
}


def relation_priority(col: Column) -> Column:
    out = F.lit(99)
    for name, p in RELATION_PRIORITY.items():
        out = F.when(col == name, p).otherwise(out)
    return out


def traverse(seeds: DataFrame, links: DataFrame, known: DataFrame, depth: int = 2, max_nodes: int = 12, max_fanout: int = 6) -> DataFrame:
    """Breadth-first from each query's seeds: query, target, source, relation, depth, found.

    seeds(query, node), links(source, target, relation), known(node, stale) with
    stale null or a reason. The fan-out limit counts visited targets too; a target
    counts as visited before it is known to exist; only found targets use the node
    budget. Every query is a partition of its own, so queries run side by side. The
    rows of a level are checkpointed: the next one builds on them and not on the plan
    that made them.
    """
    if depth not in range(4):
        raise ValueError(f"a traversal goes 0 to 3 links deep, not {depth}")
    ensure_checkpoint_dir(seeds.sparkSession)
    ranked = links.withColumn("priority", relation_priority(F.col("relation")))
    fan = Window.partitionBy("source").orderBy("priority", "target")
    visited = seeds.select("query", F.col("node").alias("target")).distinct()
    order = Window.partitionBy("query").orderBy("source")
    frontier = seeds.select("query", F.col("node").alias("source")).distinct().withColumn("turn", F.row_number().over(order))
    used = None
    out = None
    for level in range(1, depth + 1):
        # Only links that leave the frontier are ranked.
        near = ranked.join(frontier.select("source").distinct(), "source", "left_semi")
        limited = near.withColumn("slot", F.row_number().over(fan)).where(F.col("slot") <= max_fanout)
        step = frontier.join(limited, "source")
        first = Window.partitionBy("query", "target").orderBy("turn", "slot")
        fresh = step.withColumn("seen", F.row_number().over(first)).where("seen = 1").join(visited, ["query", "target"], "left_anti")
        looked = fresh.join(known.withColumnRenamed("node", "target"), "target", "left").withColumn("found", F.col("is_known").isNotNull() & F.col("stale").isNull())
        so_far = Window.partitionBy("query").orderBy("turn", "slot").rowsBetween(Window.unboundedPreceding, -1)
        looked = looked.withColumn("before", F.coalesce(F.sum(F.col("found").cast("int")).over(so_far), F.lit(0)))
        if used is None:
            looked = looked.withColumn("used", F.lit(0))
        else:
            looked = looked.join(used, "query", "left").withColumn("used", F.coalesce("used", F.lit(0)))
        kept = looked.where(F.col("before") + F.col("used") < max_nodes)
        rows = kept.select("query", "target", "source", "relation", "priority", F.lit(level).alias("depth"), "found", "stale", "turn", "slot").checkpoint()
        part = rows.drop("turn", "slot")
        out = part if out is None else out.unionByName(part)
        if level < depth:
            visited = visited.union(rows.select("query", "target")).distinct()
            again = Window.partitionBy("query").orderBy("turn", "slot")
            frontier = rows.where("found").select("query", F.col("target").alias("source"), F.row_number().over(again).alias("turn"))
            used = out.groupBy("query").agg(F.sum(F.col("found").cast("int")).alias("used"))
    return out


def closure(edges: DataFrame, starts: DataFrame, rounds: int | None = None) -> DataFrame:
    """node: everything reachable from the starts along edges(source, target), starts included.

    Each round joins the nodes that the last one added, until a round adds none;
    more than ``rounds`` of them, where given, are an error.
    """
    ensure_checkpoint_dir(starts.sparkSession)
    reached = frontier = starts.select("node").distinct().checkpoint()
    done = 0
    while True:
        step = edges.join(frontier, edges["source"] == frontier["node"], "left_semi").select(F.col("target").alias("next")).distinct()
        fresh = step.join(reached, step["next"].eqNullSafe(reached["node"]), "left_anti").select(F.col("next").alias("node")).checkpoint()
        if fresh.isEmpty():
            return reached
        if done == rounds:
            raise ValueError(f"nodes further than {rounds} links from the starts")
        done += 1
        # Partitions would add up over the rounds.
        reached = reached.union(fresh) if done % 8 else reached.union(fresh).repartition("node").checkpoint()
        frontier = fresh


def peel(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, level: the round in which a node of a dependency graph is free, from 1; null for nodes on a cycle or behind one.

    ``edges`` (source, target) say that target needs source. Nodes that need nothing
    that is still there go round by round; what no round frees hangs on a cycle. A
    round joins only the nodes that the last one freed.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    every = nodes.select("node").distinct()
    inner = edges.select("source", "target").distinct().join(every.withColumnRenamed("node", "source"), "source", "left_semi")
    waits = inner.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    state = every.join(waits, every["node"] == waits["target"], "left").select("node", F.coalesce("n", F.lit(0)).alias("n"), F.lit(None).cast("int").alias("level")).checkpoint()
    level = 1
    while True:
        free = state.where((F.col("n") == 0) & F.col("level").isNull()).select("node")
        if free.isEmpty():
            return state.select("node", "level")
        gone = inner.join(free, inner["source"] == free["node"]).groupBy("target").agg(F.count(F.lit(1)).alias("less"))
        now = F.when((F.col("n") == 0) & F.col("level").isNull(), level).otherwise(F.col("level"))
        state = state.join(gone, state["node"] == gone["target"], "left").select("node", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n"), now.alias("level")).checkpoint()
        level += 1


def cycles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, cycle: nodes of a graph that reach themselves, named by the smallest node that they reach and that reaches them.

    What peeling from the front and from the back leaves is coloured by the smallest
    node that each can reach; what that node reaches inside its colour is one
    component. Components are taken out, and what is left is coloured again.
    """
    turned = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    front = peel(edges, nodes).where("level IS NULL").select("node")
    rest = peel(_within(turned, front), front).where("level IS NULL").select("node").checkpoint()
    found = nodes.select("node", F.col("node").alias("cycle")).limit(0)
    while not rest.isEmpty():
        inside = _within(edges, rest).distinct().checkpoint()
        low = _smallest_reached(inside, rest)
        ends = [low.select(F.col("node").alias(end), F.col("low").alias(f"{end}_low")) for end in ("source", "target")]
        same = inside.join(ends[0], "source").join(ends[1], "target").where("source_low = target_low").select("source", "target").checkpoint()
        part = closure(same, low.where("node = low").select("node")).join(low, "node").checkpoint()
        sizes = part.groupBy("low").agg(F.count(F.lit(1)).alias("n"))
        loops = inside.where("source = target").select(F.col("source").alias("low")).distinct().withColumn("loop", F.lit(True))
        real = sizes.join(loops, "low", "left").where("n > 1 OR loop").select("low")
        found = found.union(part.join(real, "low").select("node", F.col("low").alias("cycle")))
        rest = rest.join(part, "node", "left_anti").checkpoint()
    return found


def _within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.withColumnRenamed("node", "source"), "source", "left_semi").join(nodes.withColumnRenamed("node", "target"), "target", "left_semi").select("source", "target")


def _smallest_reached(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, low: the smallest node that each can reach, itself included; passed along the edges until nothing changes."""
    state = nodes.select("node", F.col("node").alias("low"))
    while True:
        seen = edges.join(state.withColumnRenamed("node", "target"), "target").groupBy("source").agg(F.min("low").alias("next"))
        new = state.join(seen, state["node"] == seen["source"], "left").select("node", F.least("low", "next").alias("low"), (F.coalesce("next", "low") < F.col("low")).alias("moved")).checkpoint()
        state = new.select("node", "low")
        if new.where("moved").isEmpty():
            return state


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """source, target of edges whose target is no node."""
    return edges.join(nodes, edges["target"] == nodes["node"], "left_anti")


def impact(before: DataFrame, after: DataFrame, key: str, *columns: str) -> DataFrame:
    """key, status: UNCHANGED, STALE (changed), RECHECK_REQUIRED (gone) or NEW."""
    a = before.select(key, F.struct(*columns).alias("a"))
    b = after.select(key, F.struct(*columns).alias("b"))
    status = F.when(F.col("b").isNull(), "RECHECK_REQUIRED").when(F.col("a").isNull(), "NEW").when(F.col("a") == F.col("b"), "UNCHANGED").otherwise("STALE")
    return a.join(b, key, "full").select(key, status.alias("status"))
