"""Work that costs much a row, dealt to all cores; rows that meet by keys, dealt to as many tasks as they need."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes that one task of a scan may stand for: files are read by row groups, which are about as large.
TASK_BYTES = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal rows evenly to the cores where the input is too small to give each of them a task (one row group is one task);
    larger inputs stay as they are and are not shuffled."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if 0 < size < cores * TASK_BYTES else df


#: Rows of one task, about, where many rows meet by their keys.
TASK_ROWS = 1_000_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal ``rows`` rows by keys to tasks whose number grows with them, so that what a task sorts or holds doesn't; up to
    TASK_ROWS for each of the session's shuffle partitions Spark's own plan is left as it is."""
    parts = -(-rows // TASK_ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
