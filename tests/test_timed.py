"""Pending cases in event time: a late row takes its place, a case that rests expires."""

import datetime as dt

from quillspark.streaming import streams


def test_three_batches_with_a_late_row_and_an_expiry(spark, tmp_path):
    schema = "chat_id long, ts timestamp, kind string, fact string, branches array<string>"
    at = lambda minute: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)
    rows, out, log = f"file://{tmp_path}/rows", f"file://{tmp_path}/out", f"file://{tmp_path}/log"

    def batch(n, *values):
        spark.createDataFrame(list(values), schema).coalesce(1).write.parquet(f"{rows}/{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(rows)
        streams.pending_cases(stream, out, log, lateness="30 minutes", expiry_ms=60 * 60_000)

    batch(0, (1, at(1), "answer", "first", None), (1, at(20), "result", None, None), (2, at(2), "pending", None, ["yes", "no"]), (2, at(3), "answer", "2", None))
    batch(1, (1, at(10), "answer", "late", None), (3, at(40), "answer", "x", None))  # before the result that came already
    batch(2, (9, at(500), "answer", "y", None))  # the watermark moves on: everything is due, chats 2 and 3 rest too long
    batch(3, (9, at(501), "answer", "z", None))
    got = sorted((r["chat_id"], r["closed_by"], r["facts"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, "result", "first,late"), (2, "expired", "no"), (3, "expired", "x")]
    when = {r["chat_id"]: r["closed_at"] for r in spark.read.parquet(out).collect()}
    assert when[1] == at(20) and when[2] == at(63) and when[3] == at(100)
