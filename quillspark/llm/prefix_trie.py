"""Conversation prefix trie: adaptive radix trees over ranges of keys, joined where ranges meet.

A conversation's key is the string of its turns' ids, WIDTH big-endian bytes each. Keys are range-partitioned with their
conversation, so equal keys spread as well; each task builds a tree of its range and emits the nodes at whole turns. A
node that may reach into another range lies on the path of the range's first or last key; these paths, a few rows a task,
are folded in order of range.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Bytes of a turn's id, the first of the SHA-256 of role and text.
WIDTH = 16
#: Turns that a task's tree holds, about; bytes of conversation ids in one row of a path.
TURNS, PIECE = 200_000, 1 << 20


# --- adaptive radix tree -------------------------------------------------------------------------------------------------

class Node:
    """Where keys part or end. ``prefix``: the bytes from the parent's branching byte to here (path compression).

    Children lie in the smallest layout that holds them: up to 4 or 16 behind their bytes in order, up to 48 behind an
    index of all 256 bytes, or one slot for each byte.
    """

    __slots__ = ("prefix", "record", "room", "index", "children")

    def __init__(self, prefix: bytes, record: tuple | None = None) -> None:
        self.prefix, self.record, self.room, self.index, self.children = prefix, record, 4, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.room <= 16:
            i = self.index.find(byte)
            return self.children[i] if i >= 0 else None
        if self.room == 48:
            i = self.index[byte]
            return self.children[i - 1] if i else None
        return self.children[byte]

    def put(self, byte: int, node: Node) -> None:
        """Set a child; the layout grows when it is full."""
        if self.room <= 16:
            i = bisect_left(self.index, byte)
            if i < len(self.index) and self.index[i] == byte:
                self.children[i] = node
                return
            if len(self.children) == self.room:
                self._grow()
                self.put(byte, node)
                return
            self.index.insert(i, byte)
            self.children.insert(i, node)
        elif self.room == 48:
            if self.index[byte]:
                self.children[self.index[byte] - 1] = node
            elif len(self.children) == 48:
                self._grow()
                self.put(byte, node)
            else:
                self.children.append(node)
                self.index[byte] = len(self.children)
        else:
            self.children[byte] = node

    def _grow(self) -> None:
        held = list(self.items())
        if self.room == 4:
            self.room = 16
        elif self.room == 16:
            self.room, self.index, self.children = 48, bytearray(256), []
            for byte, node in held:
                self.put(byte, node)
        else:
            self.room, self.index, self.children = 256, bytearray(), [None] * 256
            for byte, node in held:
                self.children[byte] = node

    def items(self) -> Iterator[tuple[int, Node]]:
        """Children in order of their bytes."""
        if self.room <= 16:
            yield from zip(self.index, self.children)
        elif self.room == 48:
            yield from ((b, self.children[i - 1]) for b, i in enumerate(self.index) if i)
        else:
            yield from ((b, node) for b, node in enumerate(self.children) if node is not None)


def common(a: bytes, at: int, b: bytes) -> int:
    """How many bytes of a from ``at`` on equal the first of b."""
    if a.startswith(b, at):
        return len(b)
    low, high = 0, min(len(a) - at, len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[at + low : at + mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Tree:
    """Records (key, sizes of its turns, conversations) by key; keys may be prefixes of others."""

    def __init__(self) -> None:
        self.root: Node | None = None

    def add(self, key: bytes, conv: int, sizes: list[int]) -> None:
        if self.root is None:
            self.root = Node(key, (key, sizes, [conv]))
            return
        parent, byte, node, at = None, 0, self.root, 0
        while True:
            same = common(key, at, node.prefix)
            if same < len(node.prefix):  # the path parts inside the compressed bytes
                upper = Node(node.prefix[:same])
                upper.put(node.prefix[same], node)
                node.prefix = node.prefix[same + 1 :]
                if parent is None:
                    self.root = upper
                else:
                    parent.put(byte, upper)
                node = upper
            at += same
            if at == len(key):
                if node.record is None:
                    node.record = (key, sizes, [])
                node.record[2].append(conv)
                return
            parent, byte = node, key[at]
            node, at = parent.child(byte), at + 1
            if node is None:
                parent.put(byte, Node(key[at:], (key, sizes, [conv])))
                return


class _Frame:
    __slots__ = ("node", "begin", "end", "todo", "n", "least", "kids", "leaves", "saved", "waiting", "record")

    def __init__(self, node: Node, begin: int, end: int) -> None:
        self.node, self.begin, self.end, self.todo = node, begin, end, node.items()
        self.n = self.kids = self.leaves = self.saved = 0
        self.least, self.waiting, self.record = None, [], None
        if node.record:
            self.record, self.n, self.least = node.record, len(node.record[2]), min(node.record[2])


def _ids(convs: list[int]) -> bytes:
    return ",".join(map(str, sorted(convs))).encode()


def nodes(tree: Tree, first: bytes, last: bytes) -> tuple[list[list], list[list]]:
    """(closed, open) trie nodes of a tree, from the leaves up.

    Closed: [least, depth, parent's least or None, path and depth of an open parent, n, kids, leaves, saved, ids or None].
    Open, on the path of the first (0) or the last key (1): [path, depth, turn id, size, least, n, closed kids, their
    leaves, their savings, ids or None].
    """
    closed: list[list] = []
    opened: list[list] = []
    stack = [_Frame(tree.root, -1, len(tree.root.prefix))]
    while stack:
        frame = stack[-1]
        step = next(frame.todo, None)
        if step is not None:
            stack.append(_Frame(step[1], frame.end, frame.end + 1 + len(step[1].prefix)))
            continue
        stack.pop()
        key, sizes, _ = frame.record
        to_first, to_last = common(key, 0, first) // WIDTH, common(key, 0, last) // WIDTH
        for depth in range(frame.end // WIDTH, frame.begin // WIDTH, -1):
            ends = _ids(frame.node.record[2]) if frame.node.record and depth * WIDTH == frame.end else None
            size = sizes[depth - 1] if depth else 0
            if depth <= max(to_first, to_last):
                path = 0 if depth <= to_first else 1
                opened.append([path, depth, key[(depth - 1) * WIDTH : depth * WIDTH] if depth else b"", size, frame.least, frame.n, frame.kids, frame.leaves, frame.saved, ends])
                for row in frame.waiting:
                    row[3:5] = path, depth
                frame.kids = frame.leaves = frame.saved = 0
                frame.waiting = []
            else:
                for row in frame.waiting:
                    row[2] = frame.least
                frame.leaves = frame.leaves if frame.kids else 1
                frame.saved += (frame.n - 1) * size
                row = [frame.least, depth, None, None, None, frame.n, frame.kids, frame.leaves, frame.saved, ends]
                closed.append(row)
                frame.kids, frame.waiting = 1, [row]
        if stack:
            above = stack[-1]
            above.n += frame.n
            above.least = frame.least if above.least is None else min(above.least, frame.least)
            above.kids += frame.kids
            above.leaves += frame.leaves
            above.saved += frame.saved
            above.waiting = frame.waiting if not above.waiting else above.waiting + frame.waiting if len(above.waiting) < len(frame.waiting) else _extended(above.waiting, frame.waiting)
            above.record = above.record or frame.record
    return closed, opened


def _extended(a: list, b: list) -> list:
    a.extend(b)
    return a


# --- Spark -----------------------------------------------------------------------------------------------------------

_BUILT = "part int, path int, depth long, conv_id long, parent_conv_id long, parent_path int, parent_depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, turn binary, size long, piece int, ends binary"
_FOLDED = "part int, path int, depth long, node long, parent long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.record_batch([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tree of one range, whose rows come in order of key and conversation."""
    tree, first, last = Tree(), None, b""
    for batch in batches:
        for key, conv, sizes in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id", "sizes"))):
            first = key if first is None else first
            last = key
            tree.add(key, conv, sizes)
    if first is None:
        return
    part = TaskContext.get().partitionId()
    closed, opened = nodes(tree, first, last)
    for a in range(0, len(closed), 1 << 14):
        rows = ((part, None, depth, least, above, path, at, n, kids, leaves, saved, ends is not None and hashlib.sha256(ends).hexdigest() or None, None, None, None, None) for least, depth, above, path, at, n, kids, leaves, saved, ends in closed[a : a + (1 << 14)])
        yield _batch(list(rows), _BUILT)
    for path, depth, turn, size, least, n, kids, leaves, saved, ends in opened:
        pieces = [ends[a : a + PIECE] for a in range(0, len(ends), PIECE)] if ends else [None]
        for i, piece in enumerate(pieces):
            row = (part, path, depth, least, None, None, None, n, kids, leaves, saved, None, turn, size, i, piece)
            yield _batch([row if not i else (*row[:7], 0, 0, 0, 0, *row[11:])], _BUILT)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths in order of range: nodes of equal turns meet on a stack and are ready when the path leaves them.

    Holds one path at a time. Gives a row for each path's step (which node it is), and one for each node.
    """
    stack: list[dict] = []
    out, made = [], 0

    def close() -> None:
        node = stack.pop()
        leaves = node["leaves"] if node["kids"] else 1
        saved = node["saved"] + (node["n"] - 1) * node["size"]
        if stack:
            stack[-1]["leaves"] += leaves
            stack[-1]["saved"] += saved
        sha = node["sha"].hexdigest() if node["sha"] else None
        out.append((None, None, len(stack), node["id"], stack[-1]["id"] if stack else None, node["least"], node["n"], node["kids"], leaves, saved, sha))

    for batch in batches:
        for row in batch.to_pylist():
            depth = row["depth"]
            if not row["piece"]:
                if len(stack) <= depth or stack[depth]["turn"] != row["turn"]:
                    while len(stack) > depth:
                        close()
                    if stack:
                        stack[-1]["kids"] += 1
                    stack.append({"id": made, "turn": row["turn"], "size": row["size"], "least": row["conv_id"], "n": 0, "kids": 0, "leaves": 0, "saved": 0, "sha": None})
                    made += 1
                node = stack[depth]
                node["least"] = min(node["least"], row["conv_id"])
                for a, b in (("n", "n_convs"), ("kids", "n_children"), ("leaves", "n_leaves"), ("saved", "saved_tokens")):
                    node[a] += row[b]
                out.append((row["part"], row["path"], depth, node["id"], *[None] * 7))
            if row["ends"] is not None:
                node = stack[depth]
                if node["sha"] is None:
                    node["sha"] = hashlib.sha256()
                elif not row["piece"]:
                    node["sha"].update(b",")
                node["sha"].update(row["ends"])
        if out:
            yield _batch(out, _FOLDED)
            out.clear()
    while stack:
        close()
    if out:
        yield _batch(out, _FOLDED)


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<id, size>>) in order; the id stands for role and text, the size is the text's."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)  # the length parts role from text
    turn = F.struct(F.col("turn"), F.substring(F.sha2(told, 256), 1, 2 * WIDTH).alias("id"), F.length(text).cast("long").alias("size"))
    grouped = conversations.filter("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("t"))


def shared_head(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its hundred."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 6).cast("int")


def rebuild(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, sizes): each conversation's turns after the first h behind the first h turns of conversation
    conv_id - conv_id % 100, as one string of ids and their texts' code points."""
    turns = _turns(conversations)
    heads = turns.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("t", 1, 5).alias("head"))
    own = turns.withColumns({"base": F.expr("conv_id - conv_id % 100"), "h": shared_head(F.col("conv_id"))}).join(heads, "base", "left")
    none = F.slice("t", 1, 0)
    whole = F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), F.slice("t", F.col("h") + 1, F.greatest(F.size("t"), F.lit(1))))
    rows = own.select("conv_id", whole.alias("t"))
    return rows.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x["id"]), "")).alias("key"), F.transform("t", lambda x: x["size"]).alias("sizes"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations (columns conv_id, turn, role, text; others are not read), one row per node:
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns stand in order of ``turn``, nulls first; ties, repeated rows included, in order of their id, so the result
    does not depend on the order of rows. Null roles and texts are empty; rows without a conversation are left out; an
    empty table has no nodes, not even a root. A task holds a range of about TURNS turns and at least one whole
    conversation (WIDTH + 8 bytes a turn). The hash of the ids that end at one node is a serial sum: they pass through
    one task as text, but never lie in its memory together.
    """
    spark = conversations.sparkSession
    rebuilt = stored(rebuild(conversations), "conversations")
    turns = rebuilt.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // TURNS))
    ranges = rebuilt.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    built = stored(ranges.mapInArrow(_build, _BUILT), "trie")
    names = ["part", "path", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "turn", "size", "piece", "ends"]
    paths = built.filter("path is not null").select(*names).coalesce(1).sortWithinPartitions("part", "path", "depth", "piece")
    folded = stored(paths.mapInArrow(_fold, _FOLDED), "paths")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    met = folded.filter("part is null")
    least = met.select(F.col("node").alias("parent"), F.col("conv_id").alias("least"))
    on_paths = met.join(least, "parent", "left").withColumn("parent_conv_id", F.col("least")).select(*columns)
    steps = folded.filter("part is not null").select("part", F.col("path").alias("parent_path"), F.col("depth").alias("parent_depth"), F.col("node").alias("parent")).join(least, "parent").drop("parent")
    inside = built.filter("path is null")
    below_paths = inside.filter("parent_path is not null").join(steps, ["part", "parent_path", "parent_depth"]).withColumn("parent_conv_id", F.col("least")).select(*columns)
    found = inside.filter("parent_path is null").select(*columns).unionByName(below_paths).unionByName(on_paths)
    return found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
