"""Embedding whitening: principal components of scaled integer vectors by products of distributed block matrices."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Components that are returned at most; bytes of one block of rows, about.
COMPONENTS, BLOCK_BYTES = 8, 1 << 22

_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _scaled(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, x) of the rows whose vector holds finite numbers only, x as long."""
    c = F.col(embedding).cast("array<double>")
    odd = F.exists("c", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), c.alias("c")).filter(F.col("c").isNotNull() & ~odd & (F.size("c") > 0))
    return rows.select("vec_id", F.transform("c", lambda e: F.floor(SCALE * e) + SHIFT).alias("x"))


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows, written once, with ``row``: places without gaps, as a block matrix needs them."""
    held = stored(rows.withColumn("at", F.monotonically_increasing_id()), "vectors")
    part = F.shiftright("at", 33)
    starts, begin = {}, 0  # one entry a task that wrote rows
    for p, count in sorted(tuple(r) for r in held.groupBy(part.alias("p")).count().collect()):
        starts[p] = begin
        begin += count
    offsets = rows.sparkSession.createDataFrame(list(starts.items()), "part long, begin long")
    return held.withColumn("part", part).join(offsets, "part").select("vec_id", "x", (F.col("begin") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("row"))


def _blocks(rows: DataFrame, values: Column, n: int, width: int) -> BlockMatrix:
    """A block matrix of arrays of doubles by row, made inside the JVM."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col("row").alias("index"), array_to_vector(values).alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(max(16, BLOCK_BYTES // (8 * width)), width)


def _product(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """left x right; ``splits`` parts the sum over the middle dimension among tasks, else a narrow product is one task's."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def _scatter(matrix: BlockMatrix, splits: int) -> np.ndarray:
    return _product(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()


def components(covariance: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) by falling eigenvalue; those that are 0 to rounding are left out.

    Of either sign the one is taken whose largest entry is positive, so reruns agree.
    """
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    good = values > max(np.trace(covariance), 0) * len(covariance) * np.finfo(float).eps
    values, vectors = values[good], vectors[:, good]
    largest = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.sign(vectors[largest, np.arange(vectors.shape[1])])


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) for each vector and component.

    Vectors that are null, empty or hold null or non-finite entries are left out, and so are those of another length than
    the commonest (of equally common ones the longest). All others are the fit list. Components of variance 0 give no
    rows: neither does an empty table, a single vector, or copies of one vector only. Repeated rows and null ids count
    and are returned as often as they stand. Other columns are not read. A deviation beyond 64 bits is an error.
    """
    spark = vectors.sparkSession
    rows = _scaled(vectors, vec_id, embedding)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], _OUT)
    d = lengths["d"]
    rows = _numbered(rows.filter(F.size("x") == d))
    each = [F.struct(F.sum(F.col("x")[j]).alias("sum"), F.min(F.col("x")[j]).alias("least"), F.max(F.col("x")[j]).alias("most")) for j in range(d)]
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.array(*each).alias("x")).first()
    n, sums = facts["n"], [x["sum"] for x in facts["x"]]
    far = F.zip_with("x", F.array(*map(F.lit, sums)), lambda x, s: n * x - s)
    bound = sum(max(n * x["most"] - x["sum"], x["sum"] - n * x["least"]) ** 2 for x in facts["x"])
    kind = "long" if bound < 1 << 63 else "decimal(38,0)"  # sums of squares; a cast of what is larger than a long raises
    square = lambda f: (f.cast(kind) * f.cast(kind)).cast(kind)
    deviation = F.aggregate(far, F.lit(0).cast(kind), lambda total, f: (total + square(f)).cast(kind))
    deviation = F.when(deviation > (1 << 63) - 1, F.raise_error(F.lit("a deviation is beyond 64 bits")).cast("long")).otherwise(deviation.cast("long"))
    matrix = _blocks(rows, F.transform(far, lambda f: f / F.lit(float(n))), n, d)
    splits = max(1, min(-(-n // matrix.rowsPerBlock), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    covariance = _scatter(matrix, splits) / n
    values, axes = components(covariance, most)
    k = len(values)
    if not k:
        return spark.createDataFrame([], _OUT)
    turn = DenseMatrix(d, k, (axes / np.sqrt(values)).ravel(order="F"))
    projected = _product(matrix, BlockMatrix(spark.sparkContext.parallelize([((0, 0), turn)], 1), d, k, d, k))
    indexed = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    places = MLUtils.convertVectorColumnsToML(indexed.withColumnsRenamed(dict(zip(indexed.columns, ("row", "y")))), "y")
    whitened = stored(places.select("row", vector_to_array("y").alias("y")), "whitened")
    error = float(np.abs(_scatter(_blocks(whitened, F.col("y"), n, k), splits) / n - np.eye(k)).max())
    explained = F.array(*(F.lit(float(v)) for v in values / np.trace(covariance)))
    found = rows.select("row", "vec_id", deviation.alias("deviation")).join(whitened, "row").select("vec_id", "deviation", F.posexplode("y").alias("place", "whitened"))
    return found.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("place")].alias("explained"), F.lit(error).alias("identity_error"))
