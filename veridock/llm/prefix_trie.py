"""Trie of the turns that conversations begin with, from their global order.

A turn is named by 128 bits of the SHA-256 of its role and text, and a conversation
by the names of its turns in a row, so the bytes of a prefix of turns are a prefix
of its bytes. Conversations are range-sorted by these bytes, then by conv_id; a hot
conversation is cut between copies, as conv_id is part of the order. Each partition
is swept once: the longest common prefix of neighbours says which nodes of the stack
close, and a closed node is an interval of rows. Only the nodes on the path of a
partition's first or last row may reach into a neighbour: of these it hands on what
it knows, and one task joins them in order of partitions, with a stack as deep as
one conversation. Its input grows with the number of partitions; only the ids that
one digest is made of pass through whole, in pieces, as a digest has no parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from .arrow import slices
from .common import broadcast_if_small, join_hot, pick, write_table

#: Bytes of a turn's name.
NAME = 16
#: Fixed value: what lies between words.
GAP = r"[\x20\x09-\x0D]+"
#: Turns of a partition of the global order; bounds a task's memory.
PARTITION_TURNS = 250_000
#: Ids in one piece of an open node's members.
PIECE_IDS = 4_096
OUT_ROWS = 8_192

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: An open node by its place: partition, side (0: path of the first row, 1: of the last row only) and depth.
PLACE = "at_pid int, at_side int, at_depth long"
#: ``part`` 0: a whole node, at the place it hangs from if its parent is open; 1: what a partition knows of the open node at the place; 2: a piece of the conv_ids that end there.
SWEPT = f"{NODE}, {PLACE}, part int, seq long, name binary, words long, ids string"


def turn_name(role: Column, text: Column) -> Column:
    """128 bits of the SHA-256 of a turn, in hex; the length of the role keeps role and text apart."""
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(framed.cast("binary"), 256), 1, 2 * NAME)


def turn_paths(turns: DataFrame) -> DataFrame:
    """One row per conv_id: conv_id, base (conv_id - conv_id % 20), path of (name, words) by turn.

    A null turn comes first, a null role or text counts as empty. Turns of one number
    come in order of role, then of name. Rows without a conv_id belong to no
    conversation. Only names and counts are shuffled, dealt by base.
    """
    rows = pick(turns, conv_id="conv_id", turn="turn", role="role", text="text").where("conv_id IS NOT NULL")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.size(F.array_remove(F.split(text, GAP), ""))
    conv = F.col("conv_id").cast("long")
    named = rows.select((conv - conv % 20).alias("base"), conv.alias("conv_id"), F.struct("turn", role.alias("role"), turn_name(role, text).alias("name"), words.alias("words")).alias("t"))
    grouped = named.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", "base", F.transform("t", lambda t: F.struct(t["name"].alias("name"), t["words"].alias("words"))).alias("path"))


def spliced(paths: DataFrame) -> DataFrame:
    """Each conversation with its first h turns taken from conversation ``base``, h = crc32(decimal conv_id) % 4.

    All turns of the base if it has fewer, none if there is no such conversation. A
    window over the at most 20 conversations of a base, on the shuffle of ``turn_paths``.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    head = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("path", 1, 3)), ignorenulls=True).over(Window.partitionBy("base"))
    own = F.slice("path", h + 1, F.greatest(F.size("path"), F.lit(1)))
    return paths.withColumn("head", head).select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), h), F.slice("path", 1, 0)), own).alias("path"))


class Node:
    """A prefix on the stack: what its rows and closed children have said."""

    __slots__ = ("name", "words", "conv", "convs", "children", "leaves", "saved", "ends", "pending")

    def __init__(self, name: bytes, words: int):
        self.name, self.words = name, words
        self.conv: int | None = None
        self.convs = self.children = self.leaves = self.saved = 0
        self.ends: list[int] = []
        self.pending: list[tuple] = []

    def close(self) -> None:
        """Count the node itself, once all its members are known."""
        self.leaves += not self.children
        self.saved += (self.convs - 1) * self.words

    def take(self, child: Node) -> None:
        """Add a closed child's subtree."""
        self.children += 1
        self.leaves += child.leaves
        self.saved += child.saved

    def gain(self, conv: int, convs: int) -> None:
        """Add members of an interval below, the smallest of them ``conv``."""
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.convs += convs

    def fields(self, depth: int, ends_sha256: str | None) -> list:
        """Columns of ``NODE``; the parent is filled in when it closes."""
        return [self.conv, depth, None, self.convs, self.children, self.leaves, self.saved, ends_sha256]


class OpenNode(Node):
    """A node of the stitch: members are digested as they come, and every place that names the node is kept."""

    __slots__ = ("digest", "places")

    def __init__(self, name: bytes, words: int):
        super().__init__(name, words)
        self.digest, self.places = None, []

    def feed(self, ids: str) -> None:
        if self.digest is None:
            self.digest = hashlib.sha256()
        else:
            self.digest.update(b",")
        self.digest.update(ids.encode())


def joined(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def common_turns(a: bytes, b: bytes) -> int:
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // NAME
    return next(k for k in range(most // NAME) if a[k * NAME : k * NAME + NAME] != b[k * NAME : k * NAME + NAME])


def sweep(rows: Iterator[tuple[int, bytes, list[int]]], pid: int) -> Iterator[list]:
    """Rows of ``SWEPT`` of one partition, given as (conv_id, key, words) in order.

    A node waits for its parent to close, as the smallest member is known only then.
    """
    stack: list[Node] = []
    last, left = b"", 0

    def handed_on(node: Node, depth: int, side: int) -> Iterator[list]:
        place = [pid, side, depth]
        for child in node.pending:
            yield child + place + [0, None, None, None, None]
        yield node.fields(depth, None) + place + [1, -1, node.name, node.words, None]
        for seq in range(0, len(node.ends), PIECE_IDS):
            yield [None] * 8 + place + [2, seq, None, None, joined(node.ends[seq : seq + PIECE_IDS])]

    def closed() -> Iterator[list]:
        """Take the top from the stack. On the first row's path (the lowest ``left`` + 1 nodes) it is open to the left."""
        nonlocal left
        node, depth = stack.pop(), len(stack)
        stack[-1].gain(node.conv, node.convs)
        if depth <= left:
            left = depth - 1
            yield from handed_on(node, depth, 0)
            return
        node.close()
        for child in node.pending:
            child[2] = node.conv
            yield child + [None] * 3 + [0, None, None, None, None]
        stack[-1].take(node)
        stack[-1].pending.append(node.fields(depth, hashlib.sha256(joined(node.ends).encode()).hexdigest()))

    for conv, key, words in rows:
        turns = len(key) // NAME
        if not stack:
            stack, left = [Node(b"", 0)], turns
        else:
            for _ in range(len(stack) - 1 - common_turns(last, key)):
                yield from closed()
        for k in range(len(stack) - 1, turns):
            stack.append(Node(key[k * NAME : k * NAME + NAME], words[k]))
        stack[-1].gain(conv, 1)
        stack[-1].ends.append(conv)
        last = key
    while stack:
        node, depth = stack.pop(), len(stack)
        if stack:
            stack[-1].gain(node.conv, node.convs)
        yield from handed_on(node, depth, int(depth > left))


def stitch(rows: Iterator[tuple]) -> Iterator[list]:
    """Close the open nodes of all partitions: rows of ``SWEPT`` of parts 1 and 2, by place and seq.

    Yields every node once, and every place with the conv_id that its node has got in
    the end.
    """
    stack: list[OpenNode] = []

    def closed() -> Iterator[list]:
        node, depth = stack.pop(), len(stack)
        node.close()
        for child in node.pending:
            child[2] = node.conv
            yield child + [None] * 3
        for place in node.places:
            yield [node.conv] + [None] * 7 + list(place)
        digest = (node.digest or hashlib.sha256()).hexdigest()
        if stack:
            stack[-1].take(node)
            stack[-1].pending.append(node.fields(depth, digest))
        else:
            yield node.fields(0, digest) + [None] * 3

    along = False
    for conv, _, _, convs, children, leaves, saved, _, pid, side, depth, part, _, name, words, ids in rows:
        if part == 2:
            stack[depth].feed(ids)
            continue
        if side == 0:
            # The first row's path goes along the stack as far as the names agree.
            along = depth < len(stack) and (depth == 0 or (along and stack[depth].name == name))
        if side == 1 or not along:
            while len(stack) > depth:
                yield from closed()
            stack.append(OpenNode(name, words))
        node = stack[depth]
        node.gain(conv, convs)
        node.children += children
        node.leaves += leaves
        node.saved += saved
        node.places.append((pid, side, depth))
    while stack:
        yield from closed()


def _written(rows: Iterator[list], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    held: list[list] = []
    for row in rows:
        held.append(row)
        if len(held) >= OUT_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _map_rows(df: DataFrame, fn, out: str) -> DataFrame:
    """Run a generator over the rows of every partition."""
    spec = _parse_datatype_string(out)

    def run(batches):
        yield from _written(fn(row for columns in slices(batches, OUT_ROWS) for row in zip(*columns, strict=True)), to_arrow_schema(spec))

    return df.mapInArrow(run, spec)


def prefix_trie(paths: DataFrame, partitions: int) -> DataFrame:
    """One row per distinct prefix of the paths (conv_id, path of (name, words)), in columns of ``NODE``.

    Members of a node are the conv_ids whose path begins with it, the smallest of
    them is its conv_id. Equal paths share their nodes; an empty path is a member of
    the root. Without a path there is no node, not even a root.
    """
    names, words = F.concat_ws("", F.col("path.name")), F.col("path.words")
    ordered = paths.select("conv_id", F.unhex(names).alias("key"), words.alias("words")).repartitionByRange(partitions, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    swept = write_table(_map_rows(ordered, lambda rows: sweep(rows, TaskContext.get().partitionId()), SWEPT), "trie_swept")
    node = [c.split()[0] for c in NODE.split(", ")]
    place = [c.split()[0] for c in PLACE.split(", ")]
    # Two paths a partition and the pieces of their members: the only rows that meet in one task.
    edges = swept.where("part > 0").repartition(1).sortWithinPartitions(*place, "seq")
    stitched = write_table(_map_rows(edges, stitch, f"{NODE}, {PLACE}"), "trie_stitched")
    whole = swept.where("part = 0")
    tops = stitched.where("at_pid IS NOT NULL").select(*place, F.col("conv_id").alias("top"))
    tops, small = broadcast_if_small(tops, F.lit(32))
    hanging = whole.where("at_pid IS NOT NULL").select(*[c for c in node if c != "parent_conv_id"], *place)
    hung = hanging.join(tops, place) if small else join_hot(hanging, place, "conv_id", tops)
    return whole.where("at_pid IS NULL").select(*node).unionByName(hung.withColumnRenamed("top", "parent_conv_id").select(*node)).unionByName(stitched.where("at_pid IS NULL").select(*node))


def conversation_trie(turns: DataFrame, splice: bool = True) -> DataFrame:
    """Nodes of the trie of conversations, rebuilt by ``spliced`` or as they are.

    Returns the columns of ``NODE``: conv_id, depth, parent_conv_id (null for the
    root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Nulls, ties and
    rows without a conv_id as in ``turn_paths``; an exactly repeated turn is a turn of
    its own; an empty table gives no rows; extra columns are ignored. A conversation
    is one row of names, 32 bytes a turn, however long its texts are.
    """
    paths = turn_paths(turns)
    sizes = turns.sparkSession.conf.get("spark.sql.shuffle.partitions")
    partitions = max(int(sizes), -(-turns.count() // PARTITION_TURNS))
    return prefix_trie(spliced(paths) if splice else paths.select("conv_id", "path"), partitions)
