"""Next rows and places in an order across ranges: no group of rows has to fit one task.

Rows are dealt by ranges of (group, order) and sorted; each task looks at its range only, row after row. What a task cannot
know, the row that follows its last one and how many rows of its first group stand before it, comes from a table of one
row a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from ..sources.scratch import written

#: Rows of a range, about.
ROWS = 1_000_000


def _walk(schema: pa.Schema, leads: list[tuple[str, str]]):  # noqa: ANN202
    """A range's rows with what follows each (null at a group's end), its place in its group, and marks at the borders."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, place, first = TaskContext.get().partitionId(), None, 0, True

        def give(rows: pa.RecordBatch, after: pa.RecordBatch | None, begins: bool) -> pa.RecordBatch:
            """``after``: the row that follows the last one; none at the end of the range."""
            nonlocal place
            n, keys = rows.num_rows, rows.column("_group")
            same = np.zeros(n, bool)
            if n > 1:
                same[:-1] = pc.equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            if after is not None:
                same[-1] = keys[-1].as_py() == after.column("_group")[0].as_py()
            new = np.append(True, ~same[:-1])  # where a group begins, as far as these rows tell
            begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            places = np.arange(n) - begin + 1 + np.where(begin == 0, place, 0)
            place = int(places[-1]) if same[-1] else 0
            columns = {name: rows.column(name) for name in rows.schema.names}
            for source, name in leads:
                values = rows.column(source)
                last = after.column(source) if after is not None else pa.nulls(1, values.type)
                moved = pa.concat_arrays([values[1:], last])
                columns[name] = pc.if_else(pa.array(same), moved, pa.scalar(None, values.type))
            columns |= {"_place": pa.array(places, pa.int64()), "_part": pa.array(np.full(n, part, np.int32)), "_first": pa.array(np.arange(n) == (0 if begins else -1)), "_last": pa.array(np.arange(n) == (n - 1 if after is None else -1))}
            return pa.record_batch([columns[f.name].cast(f.type) for f in schema], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield give(held, batch.slice(0, 1), first)
                first = False
            held = batch
        if held is not None:
            yield give(held, None, first)

    return run


def in_order(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], leads: dict[str, str] | None = None, place: str | None = None) -> DataFrame:
    """``df`` with the next row's values and each row's place, counted from 1, inside its group.

    leads: new column -> column whose value in the next row it takes, null at the end of a group. place: the new column of
    places. order has to be total for a repeatable result; nulls of a group are one group. An empty table stays empty. The
    order's columns and the group may hold any number of rows.
    """
    spark, leads = df.sparkSession, [(source, name) for name, source in (leads or {}).items()]
    keys = {f"_o{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)}
    rows = df.withColumns({"_group": F.to_json(F.struct(*group), {"ignoreNullFields": "false"}), **keys})
    rows = written(rows, "rows")  # ranges are sampled from it
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS))
    by = ["_group", *keys]
    ranges = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    fields = {f.name: f for f in rows.schema}
    schema = StructType([*rows.schema, *(StructField(name, fields[source].dataType) for source, name in leads), StructField("_place", LongType()), StructField("_part", IntegerType()), StructField("_first", BooleanType()), StructField("_last", BooleanType())])
    walked = written(ranges.mapInArrow(_walk(to_arrow_schema(schema), leads), schema), "walked")
    ends = Window.orderBy("_part")  # a row a task
    sources = [source for source, _ in leads]
    firsts = walked.filter("_first").select("_part", "_group", *(F.col(s).alias(f"_lead_{i}") for i, s in enumerate(sources)))
    lasts = walked.filter("_last").select("_part", F.col("_group").alias("_last_group"), F.col("_place").alias("_count"))
    border = firsts.join(lasts, "_part")
    after = border.select("_part", "_last_group", F.lead("_group").over(ends).alias("_next_group"), *(F.lead(f"_lead_{i}").over(ends).alias(f"_next_{i}") for i in range(len(sources))))
    # A group's rows before a range: those at the ends of the ranges before, back to where the group begins.
    whole = F.col("_group") == F.col("_last_group")
    run = border.withColumn("_run", F.sum(F.when(whole & (F.lag("_last_group").over(ends) == F.col("_group")), 0).otherwise(1)).over(ends))
    upto = Window.partitionBy("_run").orderBy("_part")
    tail = run.select("_part", "_group", "_last_group", F.sum("_count").over(upto).alias("_tail"))
    before = tail.select("_part", F.when(F.lag("_last_group").over(ends) == F.col("_group"), F.lag("_tail").over(ends)).otherwise(0).alias("_before"), F.col("_group").alias("_of"))
    joined = walked.join(after.join(before, "_part"), "_part")
    out = [F.col(c) for c in df.columns]
    for i, (_, name) in enumerate(leads):
        out.append(F.when(F.col("_last") & (F.col("_last_group") == F.col("_next_group")), F.col(f"_next_{i}")).otherwise(F.col(name)).alias(name))
    if place:
        out.append((F.col("_place") + F.when(F.col("_group") == F.col("_of"), F.coalesce("_before", F.lit(0))).otherwise(0)).alias(place))
    return joined.select(*out)
