"""Structured Streaming forms: incremental ingest, query log, pending cases. Each runs on what is there and stops."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.versioned import VersionedTable
from ..sources.files import known_to_arrow, stream_files
from ..sources.readers import markdown_records

#: Files and bytes that one task of a stream of files reads.
FILES, BYTES = 2_000, 32 << 20


def as_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """New Parquet files of a table's folder as a stream; the table may also be one file."""
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{folder}/{name}*")


def _rocksdb(spark: SparkSession) -> None:
    """State on the executors' disks, checkpointed, in place of their heaps."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ingest_files(spark: SparkSession, path: str, pattern: str, store: VersionedTable, log: str, prefix: str, number: str = r"_([0-9]+)\.[a-z]+$", laws: Sequence[tuple[str, Sequence[str]]] = (), default_law: str = "ley") -> None:
    """New markdown files below ``path`` become rows of the store, if their content was not seen before.

    Whole files are the stream's rows; records are made of them as ``markdown_records`` does. Names of files seen are kept in
    files beside the checkpoint, not on the driver (on file systems that Arrow doesn't know, Spark's own file stream keeps
    them there). A file that goes before it is read ends the run, as does one too large for a row. Hashes of contents seen are
    keyed state, so a batch reads neither the store nor older files. Each batch is one commit, with its number in the
    column ``batch``; a batch that is run again after a failure commits nothing twice. Of equal contents in one batch any
    file is taken.
    """
    _rocksdb(spark)
    if known_to_arrow(path) and known_to_arrow(log):
        path = path if ":" in path else f"file://{path}"
        listed = stream_files(spark, path, pattern, f"{log.rstrip('/')}/listings", invalid="replace", partitionFiles=FILES, partitionBytes=BYTES)
        lost = F.col("content").isNull() & F.col("reason").isNotNull()
        files = listed.select("path", F.when(lost, F.raise_error(F.concat_ws(": ", "path", "reason"))).otherwise(F.col("content")).alias("content"))
    else:
        found = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
        files = found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    records = markdown_records(files, prefix, number, laws, default_law)

    def commit(rows: DataFrame, n: int) -> None:
        store.upsert(rows.withColumn("batch", F.lit(n).cast("long")), "source_path", batch=(log, n))

    records.dropDuplicates(["content_hash"]).writeStream.foreachBatch(commit).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()


def append_log(rows: DataFrame, path: str, log: str, limit: int = 2000) -> None:
    cut = rows.withColumn("query_type", F.lit("chat")).withColumn("query_text", F.substring("query_text", 1, limit))
    cut.writeStream.format("parquet").option("path", path).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()


class PendingCases(StatefulProcessor):
    """Facts of an open case per chat; a result or a new topic closes it.

    A row of kind ``pending`` brings the branches of the question that waits for an answer. An answer that is a number
    from 1 to their number makes that branch's condition a fact; any other answer is a fact itself, null is none.
    The open case is one value, read and written once for all rows of a chat in a batch: each call of the state store is a
    message to the executor's JVM and back.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.case = handle.getValueState("case", "facts array<string>, branches array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        yield self.apply(key, pd.concat(list(rows)))

    def apply(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Take rows in order of ts into the state; gives the cases that they close."""
        out, (facts, branches) = [], self.held()
        taken = sorted(zip(*(rows[c].tolist() for c in ("ts", "kind", "fact", "branches"))), key=lambda row: row[0])
        for ts, kind, fact, asked in taken:
            if kind in ("result", "topic"):
                out.append((key[0], ts, kind, ",".join(sorted(facts))))
                facts, branches = set(), []
            elif kind == "pending":
                branches = [] if asked is None else list(asked)
            elif isinstance(fact, str):
                chosen = int(fact) if fact.isdecimal() and len(fact) < 10 else 0
                facts.add(branches[chosen - 1] if 0 < chosen <= len(branches) else fact)
        self.hold(facts, branches)
        return pd.DataFrame(out, columns=["chat_id", "closed_at", "closed_by", "facts"])

    def held(self) -> tuple[set[str], list[str]]:
        """Facts and branches of the open case."""
        facts, branches = self.case.get() or ((), ())
        return set(facts), list(branches)

    def hold(self, facts: set[str], branches: list[str]) -> None:
        if facts or branches:
            self.case.update((sorted(facts), branches))
        else:
            self.case.clear()

    def close(self) -> None:
        pass


class TimedCases(PendingCases):
    """The same in order of event time, with expiry.

    Rows wait until the watermark has passed them, so those that come late, in a later batch too, take their place; then
    their timer takes them in. A case without a row for ``expiry_ms`` is closed as ``expired`` and forgotten.
    """

    def __init__(self, expiry_ms: int | None) -> None:
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts timestamp, kind string, fact string, branches array<string>")
        self.last = handle.getValueState("last", "ms long")

    @staticmethod
    def _ms(ts: pd.Timestamp) -> int:
        return -(-pd.Timestamp(ts).value // 1_000_000)  # rounded up: the row is due when this has passed

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        came = pd.concat(list(rows))
        listed = lambda b: None if b is None else list(b)
        self.waiting.appendList([(r.ts.to_pydatetime(), r.kind, r.fact, listed(r.branches)) for r in came.itertuples()])
        for ms in {self._ms(ts) for ts in came["ts"]}:
            self.handle.registerTimer(ms)
        yield pd.DataFrame([], columns=["chat_id", "closed_at", "closed_by", "facts"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803  Spark passes these by name
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=["ts", "kind", "fact", "branches"])
        due = held["ts"].map(self._ms) <= now if len(held) else pd.Series([], dtype=bool)
        if due.any():
            out = self.apply(key, held[due])
            rest = held[~due]
            self.waiting.clear()
            if len(rest):
                self.waiting.put([(r.ts, r.kind, r.fact, r.branches) for r in rest.itertuples()])
            if self.expiry_ms is not None:
                latest = max(map(self._ms, held[due]["ts"]))
                self.last.update((latest,))
                self.handle.registerTimer(latest + self.expiry_ms)
            yield out
        elif self.expiry_ms is not None and self.last.exists() and now >= self.last.get()[0] + self.expiry_ms and self.case.exists():
            out = [(key[0], pd.Timestamp(now, unit="ms"), "expired", ",".join(sorted(self.held()[0])))]
            self.case.clear()
            self.last.clear()
            yield pd.DataFrame(out, columns=["chat_id", "closed_at", "closed_by", "facts"])
        else:
            yield pd.DataFrame([], columns=["chat_id", "closed_at", "closed_by", "facts"])


def pending_cases(rows: DataFrame, path: str, log: str, lateness: str | None = None, expiry_ms: int | None = None) -> None:
    """Closed cases of rows (chat_id, ts, kind, fact, branches array<string>) with the facts gathered since the last one.

    Without ``lateness`` a batch's rows are taken when they come, those of a chat in order of ts, and state stays until a
    case closes. With it (as ``10 minutes``) rows are taken in order of event time over all batches, once the watermark has
    passed them; rows older than the watermark are dropped, and ``expiry_ms`` closes cases that rest for so long.
    """
    _rocksdb(rows.sparkSession)
    out = "chat_id long, closed_at timestamp, closed_by string, facts string"
    if lateness is None:
        closed = rows.groupBy("chat_id").transformWithStateInPandas(PendingCases(), out, "Append", "None")
    else:
        closed = rows.withWatermark("ts", lateness).groupBy("chat_id").transformWithStateInPandas(TimedCases(expiry_ms), out, "Append", "EventTime")
    closed.writeStream.format("parquet").option("path", path).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
