"""Walks and dangling edges: one shuffle, no tree beside each case."""

from quillspark.operators import trees

SCHEMA = "tree_id string, node_id string, is_root boolean, type string, branches array<struct<condition:string,next_node:string>>, next_node string"


def test_trees_are_not_joined_to_cases(spark):
    rows = [(f"t{i}", "r", True, "decision", [(f"no {j}.", f"n{j}") for j in range(20)], "") for i in range(3)] + [(f"t{i}", f"n{j}", False, "result", [], "") for i in range(3) for j in range(0, 20, 2)]
    nodes = spark.createDataFrame(rows, SCHEMA)
    cases = spark.createDataFrame([(k, f"t{k % 3}", {"n": f"no {k % 20}."}) for k in range(900)], "case_id int, tree_id string, facts map<string,string>")
    walked = trees.walk(cases, nodes)
    assert {(r.case_id, tuple(r.path), r.node_type) for r in walked.collect()} == {(k, ("r",) if k % 2 else ("r", f"n{k % 20}"), "decision" if k % 2 else "result") for k in range(900)}
    assert "Join" not in walked._jdf.queryExecution().optimizedPlan().toString()


def test_dangling_reads_nodes_once(spark):
    nodes = spark.createDataFrame([("t", "r", True, "decision", [("a", "x"), ("b", "y"), ("c", "y"), ("d", "")], "z"), ("t", "x", False, "info", [], "gone"), ("u", "y", False, "result", [], "")], SCHEMA)
    found = trees.dangling(nodes)
    assert sorted((r.tree_id, r.source, r.target, r.label) for r in found.collect()) == [("t", "r", "y", "b"), ("t", "r", "y", "c"), ("t", "x", "gone", "")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
