"""The prefix trie against plain dictionaries, and its tree against sets of keys."""

import hashlib
import random
import zlib

import pytest

from quillspark.llm import prefix_trie as P
from quillspark.llm.oracle import ORACLE
from quillspark.llm.queries import QUERIES

from ..conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string, depth int, Key string, part int"


def plain(rows):
    """{(least member, depth): (parent, n_convs, n_children, n_leaves, saved_tokens, hash)}"""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t, key=lambda x: (x[0], x[1], hashlib.sha256(f"{len(x[2].encode())}:{x[2]}{x[3]}".encode()).hexdigest()[:32]))] for c, t in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        hundred = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = tuple(turns.get(hundred, [])[:h] + own[h:])
    members = {}
    for c, key in built.items():
        for d in range(len(key) + 1):
            members.setdefault(key[:d], []).append(c)
    kids = {}
    for key in members:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in kids.get(key, [])) or 1
        saved[key] = sum(saved[k] for k in kids.get(key, [])) + (len(members[key]) - 1) * (len(key[-1][1]) if key else 0)
    out = {}
    for key, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if built[c] == key)))
        out[min(who), len(key)] = (min(members[key[:-1]]) if key else None, len(who), len(kids.get(key, [])), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_equals_plain_python_and_sql(spark, duck):
    got = found(QUERIES["op13_prefix_trie"](spark, SF))
    assert got == plain(duck.execute("select conv_id, turn, role, text from conversations").fetchall())
    answer = duck.execute(ORACLE["op13_prefix_trie"])
    names = [x[0] for x in answer.description]
    sql = [dict(zip(names, r)) for r in answer.fetchall()]
    assert got == {(r["conv_id"], r["depth"]): tuple(r[c] for c in ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in sql}


@pytest.mark.parametrize("turns,piece", [(P.TURNS, P.PIECE), (40, 7)])  # few ranges, many ranges and pieces
def test_random_conversations(spark, monkeypatch, turns, piece):
    monkeypatch.setattr(P, "TURNS", turns)
    monkeypatch.setattr(P, "PIECE", piece)
    draw, rows = random.Random(5), []
    for c in range(-250, 450, 2):
        if draw.random() < 0.3:
            told = [("user", "hello"), ("assistant", "ü🙂"), ("user", "bye")]  # a third of all are copies
        else:
            told = [(draw.choice(["user", "assistant", None]), draw.choice(["a", "bb", "", None, "ccc"])) for _ in range(draw.randrange(1, 9))]
        rows += [(c, t if t or draw.random() < 0.5 else None, *x) for t, x in enumerate(told)]
    rows += [(7, 0, "user", "x" * 100_000), (7, 0, "user", "x" * 100_000), (7, None, None, None), (None, 1, "user", "lost")]
    rows += [(9, t, "user", str(t % 3)) for t in range(400)]  # a long one
    draw.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA)
    assert found(P.prefix_trie(df)) == plain(rows)


def test_hot_conversation_spreads(spark, monkeypatch):
    """Copies of one conversation lie in many ranges; no task builds a tree of them all."""
    monkeypatch.setattr(P, "TURNS", 100)
    rows = [(1000 * c, t, "user", f"turn {t}") for c in range(1, 400) for t in range(6)]
    spread = P.rebuild(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).repartitionByRange(20, "key", "conv_id")
    sizes = spread.selectExpr("spark_partition_id() as p").groupBy("p").count().collect()
    assert len(sizes) >= 10 and max(r["count"] for r in sizes) < 150
    assert found(P.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == plain(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert P.prefix_trie(none).count() == 0
    assert P.prefix_trie(spark.createDataFrame([(None, 1, "user", "a", 1, "", 1)], SCHEMA)).count() == 0


def test_layouts_grow_and_keep_order():
    draw = random.Random(2)
    for children in (3, 4, 5, 16, 17, 48, 49, 256):
        keys = {bytes([b]) + bytes(draw.choices(range(256), k=P.WIDTH - 1)) for b in draw.sample(range(256), children)}
        tree = P.Tree()
        for i, key in enumerate(draw.sample(sorted(keys), len(keys))):
            tree.add(key, i, [1])
        assert tree.root.room == min(r for r in (4, 16, 48, 256) if r >= children)
        assert [b for b, _ in tree.root.items()] == sorted(k[0] for k in keys)
        assert all(tree.root.child(k[0]).record[0] == k for k in keys)
    tree = P.Tree()
    for i, key in enumerate([b"abcd", b"ab", b"abxy", b"", b"abcd"]):
        tree.add(key, i, [])
    assert tree.root.record[2] == [3]
    assert tree.root.child(ord("a")).prefix == b"b" and tree.root.child(ord("a")).record[2] == [1]
    assert tree.root.child(ord("a")).child(ord("c")).record[2] == [0, 4]
