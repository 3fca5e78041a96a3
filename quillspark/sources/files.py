"""Whole files as a registered data source: many small files in few tasks, and a reason beside each file that is no good; as a
stream, each file once; and as a sink, a file a row."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "record_files"
SCHEMA = "path string, size long, content string, reason string"
ARROW = pa.schema([("path", pa.string()), ("size", pa.int64()), ("content", pa.string()), ("reason", pa.string())])
#: Bytes and files a task reads, unless the options say otherwise.
PARTITION_BYTES, PARTITION_FILES = 128 << 20, 10_000
#: Bytes of content given to Spark at once; and what no row can hold.
BATCH_BYTES, ROW_BYTES = 8 << 20, (1 << 31) - 64
#: Files that the sink puts into one folder.
FOLDER_FILES = 1_000


@dataclass
class FileGroup(InputPartition):
    """Files of one task: of each folder the names from a first to a last one, and all names where tasks share the folder,
    so that it isn't listed again by each of them."""

    folders: list[tuple[str, str, str, tuple[str, ...] | None]]


class RecordFiles(DataSource):
    """Files below ``path``, a row each: path, size, content, and the reason why a file is no good (null if it is).

    Options: ``pattern`` of the names; ``skip``, names of folders that are left out, by commas; ``format``, text or json;
    ``required``, keys that a JSON object must have, by commas, inner ones after a full stop; ``partitionBytes`` and
    ``partitionFiles``, what a task reads at most (a larger file is a task's only one); ``invalid``, ``replace`` to give what is
    not UTF-8 with replacement characters, beside its reason; of streams, ``listings`` (see RecordStream). Spark's own readers charge some MB
    for opening each file, so that a task gets some dozen small ones; here only bytes and files count.

    Reasons: ``unreadable``, ``too large`` for a row, ``not UTF-8``, ``empty``, ``not JSON``, ``not an object``,
    ``missing`` with the keys. Content is null where it can't be read as text. A folder that doesn't exist has no files;
    files that go between listing and reading give no row or are unreadable. Paths are local or of a file system that
    Arrow knows (hdfs, s3, gs); for others there are Spark's own readers.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return RecordStream(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return RecordWriter(dict(self.options), schema.fieldNames(), overwrite)


class RecordReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        options = {k.lower(): v for k, v in options.items()}
        listed = lambda key: [x.strip() for x in options.get(key, "").split(",") if x.strip()]
        self.path, self.pattern, self.format = options["path"], options.get("pattern", "*"), options.get("format", "text")
        if self.format not in ("text", "json"):
            raise ValueError(f"format is text or json, not {self.format}")
        self.skip, self.required = set(listed("skip")), [k.split(".") for k in listed("required")]
        self.replace = options.get("invalid", "") == "replace"
        self.bytes, self.files = int(options.get("partitionbytes", PARTITION_BYTES)), int(options.get("partitionfiles", PARTITION_FILES))

    def partitions(self) -> list[FileGroup]:
        """Files dealt in listing order. What is kept of a folder is the borders of its group; its names if groups share it."""
        system, root = opened(self.path)
        groups: list[FileGroup] = []
        mine, size, count = [], 0, 0
        for folder, files in self._folders(system, root):
            first = 0
            named = lambda a, b, whole: (folder, files[a].base_name, files[b].base_name, None if whole else tuple(f.base_name for f in files[a : b + 1]))  # noqa: B023, E731
            for i, f in enumerate(files):
                if count and (size + (f.size or 0) > self.bytes or count >= self.files):
                    if i > first:
                        mine.append(named(first, i - 1, False))
                    groups.append(FileGroup(mine))
                    mine, size, count, first = [], 0, 0, i
                size, count = size + (f.size or 0), count + 1
            if len(files) > first:
                mine.append(named(first, len(files) - 1, first == 0))
        return [*groups, FileGroup(mine)] if mine or not groups else groups

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.path)
        known = ((k, listing(system, k[0]) if k[3] is None else system.get_file_info([f"{k[0].rstrip('/')}/{n}" for n in k[3]])) for k in partition.folders)
        yield from self._batches(system, root, (f for (_, first, last, _), found in known for f in self._matching(found) if first <= f.base_name <= last))

    def _batches(self, system: fs.FileSystem, root: str, files: Iterator[fs.FileInfo]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for f in files:
            rows.append((f"{self.path.rstrip('/')}/{f.path[len(root):].lstrip('/')}", *self._judged(system, f)))
            size += rows[-1][1] or 0
            if size >= BATCH_BYTES:
                yield batch(rows)
                rows, size = [], 0
        yield batch(rows)

    def _folders(self, system: fs.FileSystem, root: str) -> Iterator[tuple[str, list[fs.FileInfo]]]:
        """Each folder with its matching files, one folder listed at a time."""
        folders = [root]
        while folders:
            folder = folders.pop()
            found = listing(system, folder)
            yield folder, self._matching(found)
            folders += [f.path for f in reversed(found) if f.type == fs.FileType.Directory and f.base_name not in self.skip]

    def _matching(self, found: list[fs.FileInfo]) -> list[fs.FileInfo]:
        return [f for f in found if f.is_file and fnmatchcase(f.base_name, self.pattern)]

    def _judged(self, system: fs.FileSystem, f: fs.FileInfo) -> tuple[int | None, str | None, str | None]:
        """(size, content, reason) of one file."""
        if (f.size or 0) > ROW_BYTES:
            return f.size, None, "too large"
        try:
            with system.open_input_file(f.path) as file:
                raw = file.read()
        except OSError as e:
            return f.size, None, f"unreadable: {e}"
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError as e:
            return len(raw), raw.decode("utf-8", "replace") if self.replace else None, f"not UTF-8 at byte {e.start}"
        return len(raw), text, self._fault(text)

    def _fault(self, text: str) -> str | None:
        if not text.strip():
            return "empty"
        if self.format == "text":
            return None
        try:
            record = json.loads(text)
        except json.JSONDecodeError as e:
            return f"not JSON: {e.msg}"
        except RecursionError:
            return "not JSON: nested too deep"
        if not isinstance(record, dict):
            return "not an object"
        missing = [".".join(keys) for keys in self.required if not has(record, keys)]
        return f"missing: {', '.join(missing)}" if missing else None


@dataclass
class ListedFiles(InputPartition):
    """Files of one task of a stream: where their names stand in a listing."""

    listing: str
    start: int
    length: int


class RecordStream(DataSourceStreamReader):
    """Files as they come, each path once; those whose names or folders begin with ``_`` or ``.`` are left out, as by Spark.

    Names are kept in files of the folder that the option ``listings`` names, which goes with the stream's checkpoint: for
    each listing the names that were new, a line a task, and for the last one all names, a line a folder. The walk through the
    folders and the names known so far are read side by side in one order, so the driver holds one folder's names at a time.
    An offset is the number of a listing; a listing that a broken run left is part of the next batch.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.reader, self.listings = RecordReader(options), {k.lower(): v for k, v in options.items()}["listings"].rstrip("/")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"listing": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        system, root = opened(self.reader.path)
        store, folder = opened(self.listings)
        store.create_dir(folder, recursive=True)
        last = max((int(f.base_name[:-6]) for f in listing(store, folder) if f.base_name.endswith(".files")), default=0)
        draft = f"{folder}/{uuid.uuid4().hex}"
        with store.open_output_stream(f"{draft}.new") as new, store.open_output_stream(f"{draft}.all") as every:
            put = lambda file, x: file.write((json.dumps(x) + "\n").encode())
            mine, size, count, found = [], 0, 0, 0
            for place, names, came in self._side_by_side(system, root, self._known(store, f"{folder}/{last:012d}.known")):
                put(every, [place, sorted([*names, *(f.base_name for f in came)])])
                found += len(came)
                for f in came:
                    if count and (size + (f.size or 0) > self.reader.bytes or count >= self.reader.files):
                        put(new, mine)
                        mine, size, count = [], 0, 0
                    if not mine or mine[-1][0] != place:
                        mine.append([place, []])
                    mine[-1][1].append(f.base_name)
                    size, count = size + (f.size or 0), count + 1
            if mine:
                put(new, mine)
        if not found:
            store.delete_file(f"{draft}.new")
            store.delete_file(f"{draft}.all")
            return {"listing": last}
        store.move(f"{draft}.all", f"{folder}/{last + 1:012d}.known")
        store.move(f"{draft}.new", f"{folder}/{last + 1:012d}.files")  # from now on the listing counts
        if last:
            store.delete_file(f"{folder}/{last:012d}.known")
        return {"listing": last + 1}

    def _known(self, store: fs.FileSystem, path: str) -> Iterator[tuple[str, list[str]]]:
        if store.get_file_info(path).is_file:
            with store.open_input_stream(path) as file:
                for line in io.BufferedReader(file):
                    place, names = json.loads(line)
                    yield place, names

    def _side_by_side(self, system: fs.FileSystem, root: str, known: Iterator[tuple[str, list[str]]]) -> Iterator[tuple[str, list[str], list[fs.FileInfo]]]:
        """Each folder below the root with its known names and its new files; folders that went keep their names."""
        old = next(known, None)
        for folder, files in self.reader._folders(system, root):
            place = folder[len(root) :].strip("/")
            if any(x.startswith(("_", ".")) for x in place.split("/")):
                continue
            while old and old[0].split("/") < place.split("/"):
                yield *old, []
                old = next(known, None)
            names = []
            if old and old[0] == place:
                names, old = old[1], next(known, None)
            before = set(names)
            yield place, names, [f for f in files if f.base_name not in before and not f.base_name.startswith(("_", "."))]
        while old:
            yield *old, []
            old = next(known, None)

    def partitions(self, start: dict, end: dict) -> list[ListedFiles]:
        out = []
        for n in range(start["listing"] + 1, end["listing"] + 1):
            store, path = opened(f"{self.listings}/{n:012d}.files")
            at = 0
            with store.open_input_stream(path) as file:
                for line in io.BufferedReader(file):
                    out.append(ListedFiles(f"{self.listings}/{n:012d}.files", at, len(line)))
                    at += len(line)
        return out

    def read(self, partition: ListedFiles) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.reader.path)
        store, path = opened(partition.listing)
        with store.open_input_file(path) as file:
            file.seek(partition.start)
            folders = json.loads(file.read(partition.length))
        paths = (f"{root.rstrip('/')}/{place}/{n}" if place else f"{root.rstrip('/')}/{n}" for place, names in folders for n in names)
        yield from self.reader._batches(system, root, (system.get_file_info(p) for p in paths))


class RecordWriter(DataSourceArrowWriter):
    """A file for each row of a table of one text column, null as an empty file; ``prefix`` and ``suffix`` of the names by
    option. Files lie in folders of FOLDER_FILES. What a task wrote gets its place when all tasks are done; overwriting is
    refused."""

    def __init__(self, options: dict[str, str], columns: list[str], overwrite: bool) -> None:
        if len(columns) != 1 or overwrite:
            raise ValueError(f"one column is appended, not {columns}{' in place of others' if overwrite else ''}")
        self.path, self.prefix, self.suffix = options["path"], options.get("prefix", "part-"), options.get("suffix", ".txt")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = opened(self.path)
        name, n = uuid.uuid4().hex, 0
        folder = f"{root}/_{name}"
        for rows in iterator:
            for a in range(0, rows.num_rows, 256):
                for text in rows.column(0).slice(a, 256).to_pylist():
                    if n % FOLDER_FILES == 0:
                        system.create_dir(f"{folder}/{n // FOLDER_FILES:06d}", recursive=True)
                    with system.open_output_stream(f"{folder}/{n // FOLDER_FILES:06d}/{self.prefix}{name}-{n:09d}{self.suffix}") as file:
                        file.write((text or "").encode())
                    n += 1
        return Written(name, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = opened(self.path)
        for m in messages:
            if m is not None and m.files:
                system.move(f"{root}/_{m.name}", f"{root}/{m.name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = opened(self.path)
        for m in messages:
            if m is not None and m.files:
                system.delete_dir(f"{root}/_{m.name}")


@dataclass
class Written(WriterCommitMessage):
    """A task's folder and how many files are in it."""

    name: str
    files: int


def has(record: object, keys: list[str]) -> bool:
    """Whether an object has a key that isn't null, and inside that the next one."""
    for k in keys:
        record = record.get(k) if isinstance(record, dict) else None
    return record is not None


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        system, path = fs.FileSystem.from_uri(path)
    else:
        system = fs.LocalFileSystem()
    return system, path.rstrip("/") or "/"


def known_to_arrow(path: str) -> bool:
    """Whether a path is local or of a file system that Arrow opens."""
    try:
        opened(path)
    except (pa.ArrowInvalid, OSError):
        return False
    return True


def listing(system: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    return sorted(system.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda f: f.base_name)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(ARROW), ARROW)], schema=ARROW)


def read_files(spark: SparkSession, path: str, pattern: str = "*", **options: object) -> DataFrame:
    """Files below ``path`` by the source above: path, size, content, reason."""
    spark.dataSource.register(RecordFiles)
    return spark.read.format(NAME).options(pattern=pattern, **options).load(path)


def stream_files(spark: SparkSession, path: str, pattern: str, listings: str, **options: object) -> DataFrame:
    """Files that come below ``path`` as a stream by the source above, each once: path, size, content, reason."""
    spark.dataSource.register(RecordFiles)
    return spark.readStream.format(NAME).options(pattern=pattern, listings=listings, **options).load(path)


def write_files(rows: DataFrame, path: str, **options: object) -> None:
    """A file below ``path`` for each row of a table of one text column, by the sink above."""
    rows.sparkSession.dataSource.register(RecordFiles)
    rows.write.format(NAME).mode("append").options(**options).save(path)


def parted(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good files, rejected ones with their reason). Both read the files; store ``files`` first where that costs."""
    return files.filter("reason is null").drop("reason"), files.filter("reason is not null")
