"""Exact deduplication by Grace hashing.

Records are partitioned by the hash of their content, first by Spark's shuffle, then inside a task into spill files,
again and again, until a bucket fits an open-addressing table that compares complete contents.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, fresh, stored

#: Bytes of content one table may hold, and files a bucket is dealt to when it holds more.
TABLE_BYTES, FAN_OUT = 64 << 20, 16


def _hash(content: bytes) -> int:
    return xxhash.xxh3_64_intdigest(content)


class ContentTable:
    """Open addressing with linear probing over (hash, complete content)."""

    def __init__(self) -> None:
        self.slots: list[int] = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def add(self, h: int, content: bytes) -> int:
        """The entry number of this content, a new one if the table doesn't hold it."""
        slots, mask = self.slots, len(self.slots) - 1
        at = h & mask
        while (entry := slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry
            at = at + 1 & mask
        entry = slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 64
        if 2 * len(self.contents) > len(slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        slots = [-1] * (mask + 1)
        for entry, h in enumerate(self.hashes):
            at = h & mask
            while slots[at] >= 0:
                at = at + 1 & mask
            slots[at] = entry
        self.slots = slots


def _write(file, h: int, tag: bytes, content: bytes) -> None:
    file.write(struct.pack("<QII", h, len(tag), len(content)))
    file.write(tag)
    file.write(content)


def _read(path: str) -> Iterator[tuple[int, bytes, bytes]]:
    with open(path, "rb") as file:
        while head := file.read(16):
            h, n_tag, n = struct.unpack("<QII", head)
            yield h, file.read(n_tag), file.read(n)


def grace(records: Iterable[tuple[int, bytes, bytes]], limit: int, folder: str, emit: Callable[[ContentTable, list[list[bytes]]], Iterator], depth: int = 0) -> Iterator:
    """Group (hash, tag, content) records by complete content; yield what ``emit`` makes of each full table.

    Records go into one table while it stays below ``limit`` bytes. Contents that no longer fit are dealt to spill
    files by the next bits of their hash; contents the table already holds still join their group, so however many
    copies one content has, it takes its bytes once. Each file is then grouped in the same way.
    """
    table, tags, files = ContentTable(), [], {}
    shift = 60 - 4 * (depth % 15)
    salt = depth // 15  # after 15 levels, other bits
    for h, tag, content in records:
        if table.bytes >= limit:
            known = _find(table, h, content)
            if known is None:
                part = (h if not salt else _hash(content + bytes([salt]))) >> shift & FAN_OUT - 1
                if part not in files:
                    files[part] = open(os.path.join(folder, f"{depth}-{part}-{os.urandom(6).hex()}"), "wb")  # noqa: SIM115
                _write(files[part], h, tag, content)
                continue
            tags[known].append(tag)
            continue
        entry = table.add(h, content)
        if entry == len(tags):
            tags.append([])
        tags[entry].append(tag)
    yield from emit(table, tags)
    del table, tags
    for file in files.values():
        file.close()
    for file in files.values():
        yield from grace(_read(file.name), limit, folder, emit, depth + 1)
        os.remove(file.name)


def _find(table: ContentTable, h: int, content: bytes) -> int | None:
    slots, mask = table.slots, len(table.slots) - 1
    at = h & mask
    while (entry := slots[at]) >= 0:
        if table.hashes[entry] == h and table.contents[entry] == content:
            return entry
        at = at + 1 & mask
    return None


class _Out:
    """Rows gathered into Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> pa.RecordBatch | None:
        self.rows.append(row)
        self.bytes += size
        return self.flush() if len(self.rows) >= 4096 or self.bytes >= 8 << 20 else None

    def flush(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [[] for _ in self.schema]
        self.rows, self.bytes = [], 0
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


def _local(limit: int) -> Callable:
    """Groups of one partition: a row for each record (its id and its group) and one with content for each group."""
    schema = pa.schema([("grp", pa.binary()), ("row", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("sha256", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple[int, bytes, bytes]]:
            for batch in batches:
                for row, text, id_ in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    content = (text or b"").lower()  # of bytes: A-Z only
                    yield _hash(content), struct.pack("<qq?", row, id_ or 0, id_ is not None), content

        def emit(table: ContentTable, tags: list[list[bytes]]) -> Iterator[tuple]:
            for content, members in zip(table.contents, tags):
                rows = [struct.unpack("<qq?", m) for m in members]
                group = struct.pack("<q", min(r[0] for r in rows))
                sha = hashlib.sha256(content).hexdigest()
                best = max((r for r in rows), key=lambda r: (r[2], r[1], r[0]))
                for row, id_, known in rows:
                    yield (group, row, id_ if known else None, None, None, None), 0
                yield (group, best[0], best[1] if best[2] else None, len(rows), sha, content), len(content)

        out = _Out(schema)
        with tempfile.TemporaryDirectory() as folder:
            for row, size in grace(records(), limit, folder, emit):
                if batch := out.add(row, size):
                    yield batch
        yield out.flush()

    return run


def _merge(limit: int) -> Callable:
    """Groups of one hash partition over all local groups: which row stays, and how many rows there are."""
    schema = pa.schema([("grp", pa.binary()), ("keep_row", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple[int, bytes, bytes]]:
            for batch in batches:
                for group, row, id_, n, sha, content in zip(*(batch.column(i).to_pylist() for i in range(6))):
                    yield _hash(content), struct.pack("<qq?q", row, id_ or 0, id_ is not None, n) + bytes.fromhex(sha) + group, content

        def emit(table: ContentTable, tags: list[list[bytes]]) -> Iterator[tuple]:
            for members in tags:
                rows = [struct.unpack("<qq?q", m[:25]) for m in members]
                best = max(rows, key=lambda r: (r[2], r[1], r[0]))
                total = sum(r[3] for r in rows)
                for m in members:
                    yield m[57:], best[0], best[1] if best[2] else None, total, m[25:57].hex()

        out = _Out(schema)
        with tempfile.TemporaryDirectory() as folder:
            for row in grace(records(), limit, folder, emit):
                if batch := out.add(row):
                    yield batch
        yield out.flush()

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z. The row with the largest id of each group stays.

    Copies are first grouped where they are read, so a content reaches the shuffle once a partition at most, and a
    group of any size costs its one hash partition a few rows. The rows of a local group meet their result in a
    join on the local group, which is no larger than one input partition.

    Edge cases: null text counts as empty; a row with a null id stays only if its group has no other ids; of rows
    with the same id and text exactly one stays; an empty table gives an empty one.
    """
    (row,) = fresh(docs, "_row")
    rows = docs.select(F.col(text_col).cast("binary").alias("text"), F.col(id_col).cast("long").alias("id")).select(F.monotonically_increasing_id().alias(row), "text", "id")
    local = rows.mapInArrow(_local(table_bytes), "grp binary, row long, id long, n long, sha256 string, content binary")
    local = stored(local, "exact-local")
    parts = local.filter(F.col("content").isNotNull()).select("grp", "row", "id", "n", "sha256", "content")
    merged = parts.repartition(F.xxhash64("content")).mapInArrow(_merge(table_bytes), "grp binary, keep_row long, keep_id long, group_size long, sha256 string")
    found = local.filter(F.col("content").isNull()).select("grp", "row", "id").join(merged, "grp")
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha256").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; edge cases as in exact_groups.

    Decisions are joined back by id. Where an id is repeated and only some of its rows stay, those rows alone are told
    apart by the digest of their text, one row for each digest.
    """
    id_, all_, sha, digest = fresh(docs, "_id", "_all", "_sha", "_digest")
    groups = exact_groups(docs, id_col, text_col, table_bytes)
    by_id = groups.groupBy(F.col(id_col).alias(id_)).agg(F.min("kept").alias(all_), F.max("kept").alias("any"))
    dropped = by_id.filter(~F.col(all_)).select(id_)
    mixed = by_id.filter(~F.col(all_) & F.col("any")).select(id_)
    same = F.col(id_col).eqNullSafe(F.col(id_))
    whole = docs.join(dropped, same, "left_anti")
    part = docs.join(mixed, same, "left_semi").withColumn(sha, F.sha2(F.coalesce(ascii_lower(F.col(text_col).cast("string")), F.lit("")).cast("binary"), 256))
    stay = groups.filter("kept").select(F.col(id_col).alias(id_), F.col("text_sha256").alias(digest))
    part = part.join(stay, same & (F.col(sha) == F.col(digest)), "left_semi").dropDuplicates([id_col, sha])
    return whole.unionByName(part.drop(sha))
