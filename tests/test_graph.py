"""Frontier search: levels against plain Python, and plans that grow with the depth by a table a level."""

import random

import pytest

from quillspark.operators import graph


def plain(edges, seeds, depth, cap):
    near = {}
    for s, t, _, c in edges:
        for a, b in ((s, t), (t, s)):
            near.setdefault(a, {})[b] = max(c, near.get(a, {}).get(b, 0))
    near = {a: [b for b, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:cap]] for a, n in near.items()}
    out = set()
    for seed in set(seeds):
        seen, frontier = {seed}, {seed}
        for level in range(1, depth + 1):
            frontier = {b for a in frontier for b in near.get(a, [])} - seen
            seen |= frontier
            out |= {(seed, b, level) for b in frontier}
    return out


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_levels_equal_plain_python(spark, depth):
    draw = random.Random(1)
    edges = [(f"n{draw.randrange(60)}", f"n{draw.randrange(60)}", "t", draw.randrange(10) / 10) for _ in range(150)] + [("hub", f"n{i}", "t", 0.5) for i in range(60)] + [("n1", "n1", "t", 1.0)]
    seeds = ["n1", "n2", "n2", "hub", "none"]
    df = spark.createDataFrame(edges, "source_chunk_uid string, target_chunk_uid string, relation_type string, confidence double")
    got = graph.neighbourhood(df, spark.createDataFrame([(s,) for s in seeds], "uid string"), depth, cap=3)
    rows = [tuple(r) for r in got.select("seed", "uid", "level").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain(edges, seeds, depth, 3)


def test_plans_stay_linear(spark):
    df = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "t", 0.5) for i in range(20)], "source_chunk_uid string, target_chunk_uid string, relation_type string, confidence double")
    seeds = spark.createDataFrame([("n0",)], "uid string")
    sizes = [graph.neighbourhood(df, seeds, depth)._jdf.queryExecution().optimizedPlan().toString().count("\n") for depth in (2, 3, 4, 5)]
    steps = [b - a for a, b in zip(sizes, sizes[1:])]
    assert max(steps) <= min(steps) + 2 and max(steps) <= 8


def test_walks_by_signature(spark):
    """Each case takes the way that plain Python finds; cases that agree in what matters share one signature."""
    from quillspark.operators import trees

    branch = lambda *b: [{"condition": c, "next_node": n} for c, n in b]
    nodes = spark.createDataFrame(
        [("t", "r", True, "decision", branch(("Big Order", "a"), ("paid", "b")), None), ("t", "a", False, "info", [], "r"), ("t", "b", False, "decision", branch(("late or lost", "c")), None), ("t", "c", False, "result", [], None), ("u", "r", True, "info", [], "gone")],
        "tree_id string, node_id string, is_root boolean, type string, branches array<struct<condition:string,next_node:string>>, next_node string")
    facts = [{"size": "big"}, {"size": "big", "noise": "17"}, {"paid": "true"}, {"paid": "TRUE", "how": "LATE", "x": ""}, {"paid": "false"}, {}, None, {"how": None}]
    cases = [(i, t, f) for i, (t, f) in enumerate((t, f) for t in ("t", "u", "none") for f in facts)]
    df = spark.createDataFrame(cases, "case_id int, tree_id string, facts map<string,string>")
    got = {r["case_id"]: (r["path"], r["node_type"]) for r in trees.walk(df, nodes).collect()}
    ways = [["r", "a"], ["r", "a"], ["r", "b"], ["r", "b", "c"], ["r"], ["r"], ["r"], ["r"]]
    kinds = ["info", "info", "decision", "result", "decision", "decision", "decision", "decision"]
    assert got == {**{i: (w, k) for i, (w, k) in enumerate(zip(ways, kinds))}, **{8 + i: (["r"], "info") for i in range(8)}}
    assert trees.signatures(df, nodes).filter("tree_id = 't'").select("_sig").distinct().count() == 5
