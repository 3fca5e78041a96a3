"""The citation graph: neighbours, expansion, derived edges, integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spread import dealt
from ..sources.scratch import written
from .ordered import in_order

TRIPLE = ["source_chunk_uid", "target_chunk_uid", "relation_type"]


def symmetric(edges: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """(node, neighbour, relation_type, confidence), each edge seen from both ends."""
    if types:
        edges = edges.filter(F.col("relation_type").isin(*types))
    there = edges.select(F.col("source_chunk_uid").alias("node"), F.col("target_chunk_uid").alias("neighbour"), "relation_type", "confidence")
    back = edges.select(F.col("target_chunk_uid").alias("node"), F.col("source_chunk_uid").alias("neighbour"), "relation_type", "confidence")
    return there.unionByName(back)


def capped_neighbours(edges: DataFrame, cap: int, types: Sequence[str] | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """At most ``cap`` neighbours of a node, each once, by confidence, then uid. nodes: those (node) whose neighbours are
    wanted; edges of others are left out before anything is shuffled."""
    near = symmetric(edges, types)
    if nodes is not None:
        near = near.join(nodes.select("node").distinct(), "node", "left_semi")
    near = near.groupBy("node", "neighbour").agg(F.max("confidence").alias("confidence"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("confidence"), "neighbour"))
    return near.withColumn("_n", rank).filter(F.col("_n") <= cap).drop("_n")


def adjacency(edges: DataFrame, cap: int, types: Sequence[str] | None = None) -> DataFrame:
    """(uid, near): a row a node with its at most ``cap`` neighbours."""
    near = capped_neighbours(edges, cap, types)  # is dealt by node already
    return near.groupBy(F.col("node").alias("uid")).agg(F.collect_set("neighbour").alias("near"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 1, cap: int = 5, types: Sequence[str] | None = None) -> DataFrame:
    """(seed, uid, level) within ``depth`` steps of each seed (column uid), breadth first, without the seed itself.

    The loop runs ``depth`` times whatever the data. Beyond one step the packed neighbours and each level are written, so a
    level reads tables only: a step costs its frontier, and plans grow with the depth by one table, not by all before.
    """
    reached = seeds.select(F.col("uid").alias("seed"), "uid").distinct()
    near = adjacency(edges, cap, types)
    if depth <= 1:
        found = reached.join(near, "uid").select("seed", F.explode("near").alias("uid")).filter("uid <> seed").distinct()
        return found.withColumn("level", F.lit(1))
    near, levels = written(near, "near"), []
    frontier, visited = reached, [written(reached, "level")]
    for level in range(1, depth + 1):
        step = frontier.join(near, "uid").select("seed", F.explode("near").alias("uid")).distinct()
        seen = visited[0]
        for before in visited[1:]:
            seen = seen.unionByName(before)
        step = step.join(seen, ["seed", "uid"], "left_anti")
        frontier = written(step, "level") if level < depth else step
        visited.append(frontier)
        levels.append(frontier.withColumn("level", F.lit(level)))
    found = levels[0]
    for more in levels[1:]:
        found = found.unionByName(more)
    return found


def votes(edges: DataFrame, hits: DataFrame, cap: int = 5, top: int = 5) -> DataFrame:
    """(query_id, uid, votes): neighbours of a query's hits by how many hits they touch; hits themselves are left out."""
    near = capped_neighbours(edges, cap, nodes=hits.select(F.col("uid").alias("node"))).select(F.col("node").alias("uid"), "neighbour")
    found = hits.join(near, "uid").groupBy("query_id", F.col("neighbour").alias("uid")).agg(F.count_distinct("uid").alias("votes"))
    found = found.join(hits.select("query_id", "uid"), ["query_id", "uid"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("votes"), "uid"))
    return found.withColumn("_n", rank).filter(F.col("_n") <= top).drop("_n")


def broken(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges with an end that is no chunk."""
    known = chunks.select(F.col("chunk_uid").alias("_uid")).distinct().withColumn("_ok", F.lit(True))
    out = edges.join(known.withColumnsRenamed({"_uid": "source_chunk_uid", "_ok": "_source"}), "source_chunk_uid", "left")
    out = out.join(known.withColumnsRenamed({"_uid": "target_chunk_uid", "_ok": "_target"}), "target_chunk_uid", "left")
    return out.filter(F.col("_source").isNull() | F.col("_target").isNull()).select(*edges.columns)


def precedence(chunks: DataFrame) -> DataFrame:
    """Last chunk of each article -> first chunk of the next one of its law, as precede_a edges."""
    ends = chunks.groupBy("law_tag", "num").agg(F.max_by("chunk_uid", F.struct("chunk_index", "chunk_uid")).alias("source_chunk_uid"), F.min_by("chunk_uid", F.struct("chunk_index", "chunk_uid")).alias("first_chunk_uid"))
    found = in_order(ends, ["law_tag"], ["num"], {"target_chunk_uid": "first_chunk_uid"})
    return found.filter(F.col("target_chunk_uid").isNotNull()).select("source_chunk_uid", "target_chunk_uid", F.lit("precede_a").alias("relation_type"))


def citations_to_edges(cited: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_uid, law_tag, num) cited -> menciona edges to the last chunk of that article, without loops, each once."""
    target = chunks.groupBy("law_tag", "num").agg(F.max_by("chunk_uid", F.struct("chunk_index", "chunk_uid")).alias("target_chunk_uid"))
    found = cited.join(target, ["law_tag", "num"]).filter(F.col("chunk_uid") != F.col("target_chunk_uid"))
    return found.select(F.col("chunk_uid").alias("source_chunk_uid"), "target_chunk_uid", F.lit("menciona").alias("relation_type")).distinct()


def merged(*tables: DataFrame) -> DataFrame:
    """Edges of several origins, one of each triple.

    The tables are counted, so that the number of tasks grows with the edges.
    """
    out = tables[0].select(*TRIPLE)
    for t in tables[1:]:
        out = out.unionByName(t.select(*TRIPLE))
    return dealt(out, sum(t.count() for t in tables), *TRIPLE).distinct()


def prefixes(uid: str) -> Column:
    """All prefixes of a uid that end before a literal underscore, and the uid itself."""
    parts = F.split(F.col(uid), "_")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "_"))


def fetch(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """(uid, chunk_uid): the chunk of that uid, else the first, by uid, whose uid continues it after an underscore.

    Prefixes are exploded into an equi-join, so no pair of uids is compared by position.
    """
    keys = chunks.select("chunk_uid", F.explode(prefixes("chunk_uid")).alias("uid"))
    found = keys.join(wanted.select("uid").distinct(), "uid").groupBy("uid")
    return found.agg(F.min(F.struct((F.col("chunk_uid") != F.col("uid")).alias("inexact"), "chunk_uid")).alias("_best")).select("uid", "_best.chunk_uid")


def labels(edges: DataFrame, names: DataFrame, missing: str = "(not found)") -> DataFrame:
    """(uid, label) of every node that an edge starts from; names: (uid, label)."""
    nodes = edges.select(F.col("source_chunk_uid").alias("uid")).distinct()
    return nodes.join(names, "uid", "left").select("uid", F.coalesce("label", F.lit(missing)).alias("label"))
