"""Order across ranges against plain Python; one group of all rows lies in many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import graph, ordered


def plain(rows):
    out, groups = [], {}
    for g, n, v in rows:
        groups.setdefault(g, []).append((n, v))
    for g, held in groups.items():
        held.sort()
        out += [(g, n, v, held[i + 1][0] if i + 1 < len(held) else None, held[i + 1][1] if i + 1 < len(held) else None, i + 1) for i, (n, v) in enumerate(held)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("groups", [1, 3, 400])
@pytest.mark.parametrize("size", [50, 1_000_000])
def test_leads_and_places(spark, monkeypatch, groups, size):
    monkeypatch.setattr(ordered, "ROWS", size)
    draw = random.Random(groups)
    rows = [(draw.choice([None, *(f"g{i}" for i in range(groups))]) if groups > 1 else "g", n, f"v{n}") for n in draw.sample(range(100_000), 900)]
    df = spark.createDataFrame(rows, "g string, n long, v string")
    got = ordered.in_order(df, ["g"], ["n"], {"next_n": "n", "next_v": "v"}, "place").collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)


def test_one_law_lies_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS", 100)
    chunks = spark.range(2000).select(F.lit("law").alias("law_tag"), F.col("id").alias("num"), F.concat(F.lit("u"), "id").alias("chunk_uid"), F.lit(0).alias("chunk_index"))
    edges = graph.precedence(chunks)
    assert edges.count() == 1999
    assert {r[0] for r in edges.select(F.substring("source_chunk_uid", 2, 9).cast("long") + 1 - F.substring("target_chunk_uid", 2, 9).cast("long")).distinct().collect()} == {0}
    parts = ordered.in_order(chunks, ["law_tag"], ["num"], place="place").select(F.spark_partition_id().alias("p"), "place").groupBy("p").count().collect()
    assert sum(r["count"] for r in parts) == 2000
    plan = edges._jdf.queryExecution().toString()
    assert "Window [lead(_first" not in plan.replace("\n", "")  # no window over a law


def test_empty(spark):
    assert ordered.in_order(spark.createDataFrame([], "g string, n long"), ["g"], ["n"], {"m": "n"}, "place").collect() == []
