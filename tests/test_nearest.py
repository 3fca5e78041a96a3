"""Vector search by blocks against plain sums, and what a task holds of texts."""

import math
import random

import pyarrow as pa
import pytest

from quillspark.operators import retrieval


@pytest.mark.parametrize("pairs", [retrieval.PAIRS, 50])
def test_blocks_find_what_sums_find(spark, monkeypatch, pairs):
    draw = random.Random(3)
    rows = [(f"u{i}", draw.choice("abc"), [draw.randrange(-2, 3) * 1.0 for _ in range(draw.choice([2, 3]))]) for i in range(300)]
    rows += [("null", "a", None), ("hole", "a", [1.0, None, 1.0]), ("zero", "a", [0.0, 0.0, 0.0]), ("no law", None, [1.0, 1.0, 1.0])]
    asked = [(i, draw.choice("abc"), [draw.randrange(-2, 3) + 0.5 for _ in range(3)]) for i in range(9)] + [(9, "a", [0.0, 0.0, 0.0]), (10, None, [1.0, 1.0, 1.0])]
    chunks = spark.createDataFrame(rows, "uid string, law_tag string, embedding array<float>")
    queries = spark.createDataFrame(asked, "query_id long, law_tag string, embedding array<float>")
    monkeypatch.setattr(retrieval, "PAIRS", pairs)
    for by in ([], ["law_tag"]):
        want = set()
        for q, law, v in asked:
            fit = [(u, w) for u, l, w in rows if w and None not in w and len(w) == 3 and any(w) and any(v) and (not by or None is not l == law)]
            sims = [(-math.floor(sum(a * b for a, b in zip(v, w)) / math.hypot(*v) / math.hypot(*w) * 1e6 + 0.5) / 1e6, u) for u, w in fit]
            want |= {(q, u, -s) for s, u in sorted(sims)[:7]}
        got = {(r.query_id, r.uid, round(r.similarity, 6)) for r in retrieval.match_chunks(queries, chunks, 7, by).collect()}
        assert {(q, u) for q, u, _ in got} == {(q, u) for q, u, _ in want} and len(got) == len(want)
    plan = type("Sent", (), {"value": retrieval._Asked([(1, [], [1.0, 0.0])])})
    schema = pa.schema([("query_id", pa.int64()), ("uid", pa.string()), ("similarity", pa.float64())])
    batch = pa.record_batch([pa.array([f"u{i:04d}" for i in range(1000)]), pa.array([[]] * 1000, pa.list_(pa.string())), pa.array([[1.0, float(i)] for i in range(1000)])], names=["uid", "_by", "_v"])
    out = list(retrieval._nearest(plan, 3, schema)(iter([batch])))
    assert [u for b in out for u in b.column("uid").to_pylist()] == ["u0000", "u0001", "u0002"]  # a task gives k rows, not all pairs


def test_counts_come_in_pieces(monkeypatch):
    monkeypatch.setattr(retrieval, "OUT_ROWS", 10)
    plan = type("Sent", (), {"value": ["aa", "bb"]})
    batch = pa.record_batch([pa.array([f"u{i}" for i in range(100)]), pa.array(["aa bb aa"] * 100), pa.array(["aa"] * 100)], names=["uid", "content", "_h"])
    out = list(retrieval._count(plan)(iter([batch])))
    assert sum(b.num_rows for b in out) == 200 and max(b.num_rows for b in out) <= 11
