"""Rows that meet by keys are dealt to tasks whose number grows with them."""

from quillspark.functions import spread
from quillspark.operators import graph
from quillspark.plans import tables
from tests.conftest import SF


def most_in_a_task(df):
    return max(df.rdd.glom().map(len).collect())


def test_merged_edges_of_a_task_do_not_grow(spark, monkeypatch):
    monkeypatch.setattr(spread, "TASK_ROWS", 100)
    for n in (1000, 4000):
        edges = spark.range(n).selectExpr("concat('a', id div 2) source_chunk_uid", "'b' target_chunk_uid", "'r' relation_type")
        found = graph.merged(edges, edges.filter("source_chunk_uid < 'a3'"))
        assert found.count() == n // 2 and most_in_a_task(found) < 150


def test_law_chunks_of_a_task_do_not_grow(spark, monkeypatch):
    want = sorted(r.chunk_uid for r in tables.law_chunks(spark, SF).collect())
    monkeypatch.setattr(spread, "TASK_ROWS", 500)
    found = tables.law_chunks(spark, SF)
    assert sorted(r.chunk_uid for r in found.collect()) == want and most_in_a_task(found) < 1000
