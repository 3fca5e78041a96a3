"""Stored inverted lists: vectors on disk by list, with short codes; searched without a fit, extended without a rewrite.

An index is a folder: ``centers`` and ``settings`` (small tables) and ``lists``, partitioned by list. A row of ``lists``
holds a vector's code, four bits a number, beside the vector itself; as columns lie apart in the files, a search reads the
codes of the lists that it probes, and whole vectors only of its best candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from . import retrieval

#: Codes reach to this many times the root mean square of all numbers of the fitted vectors; whole vectors are compared
#: for so many candidates a hit; stored vectors that ask when the number of probes is chosen.
REACH, CANDIDATES, ASKED = 3.0, 8, 200


def _units(rows: DataFrame, *keep: str) -> DataFrame:
    """Rows with ``_v``, the vector at unit length as doubles; null vectors and those of length 0 or not finite go."""
    v = rows.select(*keep, vectors.doubles("embedding").alias("_v")).withColumn("_l", vectors.norm(F.col("_v")))
    return v.filter((F.col("_l") > 0) & (F.col("_l") < float("inf"))).withColumn("_v", F.transform("_v", lambda x: x / F.col("_l"))).drop("_l")


def encode(units: np.ndarray, reach: float) -> np.ndarray:
    """Four bits a number, two numbers a byte."""
    levels = np.clip(np.round((units / reach + 1) * 7.5), 0, 15).astype(np.uint8)
    if levels.shape[1] % 2:
        levels = np.pad(levels, ((0, 0), (0, 1)))
    return levels[:, 0::2] << 4 | levels[:, 1::2]


def decode(codes: np.ndarray, dimension: int, reach: float) -> np.ndarray:
    levels = np.empty((len(codes), 2 * codes.shape[1]), np.float32)
    levels[:, 0::2], levels[:, 1::2] = codes >> 4, codes & 15
    return (levels[:, :dimension] / 7.5 - 1) * reach


def _flat(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _settings(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray, dict]:
    """(numbers of the lists, their centers, settings): as many rows as the index has lists."""
    rows = spark.read.parquet(f"{path}/centers").orderBy("list").collect()
    return np.array([r["list"] for r in rows]), np.array([r["center"] for r in rows]), spark.read.parquet(f"{path}/settings").first().asDict()


def nearest_lists(units: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """Each vector's n lists of smallest distance, nearest first."""
    far = (centers**2).sum(axis=1) - 2 * units @ centers.T
    return np.argsort(far, axis=1, kind="stable")[:, :n]


def build_index(chunks: DataFrame, path: str, lists: int | None = None, recall: float = 0.9, k: int = 10) -> None:
    """Fit lists to a bounded sample of ``chunks`` (uid, embedding), write every vector, choose the number of probes.

    The number is the smallest at which ASKED stored vectors find ``recall`` of their k exact neighbours and half of what
    is missing to 1 beside, kept for what the codes lose. Vectors of another length than the commonest are not stored.
    """
    spark = chunks.sparkSession
    rows = _units(chunks, "uid")
    shape = rows.groupBy(F.size("_v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x) / F.size("_v")).alias("square")).orderBy(F.desc("n"), F.desc("d")).first()
    if shape is None:
        raise ValueError("no vectors to index")
    centers = retrieval.fit_lists(chunks.filter(F.size("embedding") == shape["d"]), lists or retrieval.list_count(shape["n"]))
    centers.write.mode("overwrite").parquet(f"{path}/centers")
    keep = {"dimension": int(shape["d"]), "reach": float(REACH * shape["square"] ** 0.5), "probes": 0, "recall": 0.0}
    spark.createDataFrame([keep]).write.mode("overwrite").parquet(f"{path}/settings")
    add_vectors(chunks, path, fresh=True)
    probes, found = _measure(spark, path, recall + (1 - recall) / 2, k)
    spark.createDataFrame([{**keep, "probes": probes, "recall": found}]).write.mode("overwrite").parquet(f"{path}/settings")


def add_vectors(chunks: DataFrame, path: str, fresh: bool = False) -> None:
    """Assign vectors to the stored lists and append them; uids that are there keep their vector, of repeated ones one is
    taken. A large list is written by several tasks."""
    spark = chunks.sparkSession
    names, centers, settings = _settings(spark, path)
    d, reach = settings["dimension"], settings["reach"]
    new = chunks.select("uid", F.col("embedding").cast("array<float>").alias("embedding")).groupBy("uid").agg(F.min(F.struct(F.xxhash64("embedding").alias("h"), "embedding")).alias("_e")).select("uid", "_e.embedding")
    if not fresh:
        new = new.join(spark.read.parquet(f"{path}/lists").select("uid"), "uid", "left_anti")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units = _flat(batch.column("_v"), d)
                codes = encode(units, reach)
                data = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.record_batch([batch.column("uid"), data, batch.column("embedding"), pa.array(names[nearest_lists(units, centers, 1)[:, 0]].astype(np.int32))], names=["uid", "code", "embedding", "list"])

    rows = _units(new.withColumn("_e", F.col("embedding")), "uid", "_e").filter(F.size("_v") == d).withColumnRenamed("_e", "embedding")
    assigned = rows.mapInArrow(assign, "uid string, code binary, embedding array<float>, list int")
    assigned.hint("rebalance", "list").sortWithinPartitions("list", "uid").write.mode("overwrite" if fresh else "append").partitionBy("list").parquet(f"{path}/lists")


def _measure(spark: SparkSession, path: str, recall: float, k: int) -> tuple[int, float]:
    """(probes, share found): how many lists the neighbours of ASKED stored vectors, all compared exactly, lie in."""
    names, centers, _ = _settings(spark, path)
    stored = spark.read.parquet(f"{path}/lists").select("uid", "embedding", "list")
    total = stored.count()
    asks = stored.filter(F.pmod(F.xxhash64("uid", F.lit(7)), F.lit(total)) < ASKED).limit(2 * ASKED).select(F.col("uid").alias("query_id"), "embedding")
    hits = retrieval.match_chunks(asks, stored, k).join(stored.select("uid", "list"), "uid").groupBy("query_id").agg(F.collect_list("list").alias("lists"))
    rows = hits.join(_units(asks, "query_id"), "query_id").collect()  # at most 2 * ASKED
    if not rows:
        return len(names), 1.0
    order = names[nearest_lists(np.array([r["_v"] for r in rows]), centers, len(names))]
    ranks = np.sort([int(np.flatnonzero(o == x)[0]) + 1 for o, r in zip(order, rows) for x in r["lists"]])
    probes = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)])
    return probes, float((ranks <= probes).mean())


class _Candidates:
    """The best ``most`` codes of each query so far; a task holds queries * most of them."""

    def __init__(self, queries: int, most: int) -> None:
        self.most, self.scores = most, [np.empty(0, np.float32)] * queries
        self.uids = [np.empty(0, object)] * queries
        self.lists = [np.empty(0, np.int32)] * queries

    def add(self, query: int, scores: np.ndarray, uids: np.ndarray, list_: int) -> None:
        if len(scores) > self.most:
            best = np.argpartition(-scores, self.most - 1)[: self.most]
            scores, uids = scores[best], uids[best]
        s, u = np.append(self.scores[query], scores), np.append(self.uids[query], uids)
        which = np.append(self.lists[query], np.full(len(scores), list_, np.int32))
        if len(s) > self.most:
            best = np.lexsort((u, -s))[: self.most]
            s, u, which = s[best], u[best], which[best]
        self.scores[query], self.uids[query], self.lists[query] = s, u, which


def candidates(queries: DataFrame, path: str, k: int = 10, probes: int | None = None) -> DataFrame:
    """(query_id, list, uid): by their codes the best CANDIDATES * k vectors of each query's nearest lists, and ties.

    Queries are taken in parts of retrieval.QUERY_ROWS, so what is sent to the tasks has a bound; partitions of lists that
    no query of a part probes are not read.
    """
    spark = queries.sparkSession
    names, centers, settings = _settings(spark, path)
    d, reach, n = settings["dimension"], settings["reach"], probes or settings["probes"]
    kind = dict(queries.dtypes)["query_id"]
    asked = _units(queries, "query_id").filter(F.size("_v") == d).select(F.col("query_id").cast("string").alias("query_id"), "_v")
    found = None
    for part in retrieval._parts(asked):
        rows = part.collect()  # QUERY_ROWS at most
        ids, units = [r["query_id"] for r in rows], np.array([r["_v"] for r in rows], np.float32).reshape(len(rows), d)
        near = names[nearest_lists(units, centers, n)] if rows else np.empty((0, n), int)
        by_list = {int(x): np.flatnonzero((near == x).any(axis=1)) for x in np.unique(near)}
        sent = spark.sparkContext.broadcast((ids, units, by_list))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ids, units, by_list = sent.value
            best = _Candidates(len(ids), CANDIDATES * k)
            for batch in batches:
                lists = batch.column("list").to_numpy()
                uids = batch.column("uid").to_numpy(zero_copy_only=False)
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(lists), -1)
                for x in np.unique(lists):
                    rows_ = np.flatnonzero(lists == x)
                    whom = by_list[int(x)]
                    scores = decode(codes[rows_], d, reach) @ units[whom].T
                    for j, query in enumerate(whom):
                        best.add(query, scores[:, j], uids[rows_], x)
            for i, query in enumerate(ids):
                m = len(best.uids[i])
                if m:
                    yield pa.record_batch([pa.array([query] * m), pa.array(best.lists[i], pa.int32()), pa.array(best.uids[i].tolist(), pa.string()), pa.array(best.scores[i], pa.float32())], names=["query_id", "list", "uid", "score"])

        codes = spark.read.parquet(f"{path}/lists").filter(F.col("list").isin([int(x) for x in by_list])).select("list", "uid", "code")
        scored = codes.mapInArrow(scan, "query_id string, list int, uid string, score float")
        found = scored if found is None else found.unionByName(scored)
    best = retrieval.top(found, CANDIDATES * k, F.desc("score"), F.col("uid"))
    return best.select(F.col("query_id").cast(kind).alias("query_id"), "list", "uid")


def search_index(queries: DataFrame, path: str, k: int = 10, probes: int | None = None) -> DataFrame:
    """Approximate vector search in a stored index: for each query (query_id, embedding) k hits, cosines exact.

    Nothing is fitted. Whole vectors are read for the candidates alone, from the lists that hold them: where the candidates
    are few enough to be broadcast, their lists prune the scan. Queries without a vector of the index's length get no hits.
    """
    best = candidates(queries, path, k, probes)
    whole = queries.sparkSession.read.parquet(f"{path}/lists").select("list", "uid", F.col("embedding").alias("_e"))
    asked = _units(queries, "query_id").withColumnRenamed("_v", "_q")
    rows = whole.join(best, ["list", "uid"]).join(asked, "query_id")
    e = vectors.doubles("_e")
    cosine = vectors.dot(F.col("_q"), e) / vectors.norm(e)
    return retrieval.top(rows.select("query_id", "uid", F.round(cosine, 6).alias("similarity")), retrieval.clamp_k(k)).withColumn("origin", F.lit("lists"))


def search_cost(queries: DataFrame, path: str, k: int = 10, probes: int | None = None) -> dict[str, float]:
    """What a search takes, as means over its queries: shares of all vectors whose code is read, that are compared whole,
    and of the bytes of all vectors that both come to."""
    spark = queries.sparkSession
    names, centers, settings = _settings(spark, path)
    d, n = settings["dimension"], probes or settings["probes"]
    sizes = {r["list"]: r["count"] for r in spark.read.parquet(f"{path}/lists").groupBy("list").count().collect()}  # one row a list
    asked = [r["_v"] for r in _units(queries, "query_id").filter(F.size("_v") == d).select("_v").limit(retrieval.QUERY_ROWS).collect()]
    near = names[nearest_lists(np.array(asked), centers, n)]
    total = sum(sizes.values())
    codes = float(np.mean([sum(sizes.get(int(x), 0) for x in row) for row in near])) / total
    whole = candidates(queries, path, k, probes).count() / len(asked) / total
    return {"codes": codes, "whole": whole, "bytes": codes * ((d + 1) // 2) / (4 * d) + whole}
