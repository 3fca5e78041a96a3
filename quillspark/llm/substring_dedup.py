"""Removal of repeated substrings by suffix arrays over shards that need not fit in memory.

Any string of ``length`` bytes that occurs twice holds an anchor, a short string that the same rule picks in both places
(the least hash in each window of positions). Anchors that occur more than once bring the text around them to the shard of
their hash; there an externally sorted suffix array with common-prefix values finds the repeated strings themselves.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  for binary_length
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .induced_sort import InducedSorter
from .shared import release, stored

LENGTH, ANCHOR = 100, 24
#: Bytes of a shard aimed at, and bytes that its queues keep in memory; more of either goes through files.
SHARD_BYTES, QUEUE_BYTES = 6 << 20, 64 << 20
#: Windows whose anchors are picked at once, so that arrays stay in the processor's cache; a position in a piece fits the 24
#: bits beside its hash.
PIECE = 1 << 18
#: Stretches a task remembers to drop its own copies before they are shuffled; the number changes no result.
REMEMBERED = 150_000
#: Bits of a run's number of strings, beside its begin; no anchor stands for more than ``length - ANCHOR + 1`` strings.
RUN_BITS = 10
#: Stands between the stretches of a shard; UTF-8 has no such byte.
GAP = 255

_U = np.uint64


def anchors(texts: list[bytes], length: int = LENGTH, width: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, begin, number, hash): runs of strings of ``length`` bytes, by their first begin and how many follow
    each other, that have one anchor, and its hash. Every string is in one run."""
    none = np.zeros(0, np.int64)
    if sum(map(len, texts)) < length:
        return none, none, none, none
    flat = np.frombuffer(b"".join(texts), np.uint8)
    n = len(flat)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    whole = np.ones(n - length + 1, bool)  # windows inside one text
    for e in ends[:-1]:
        whole[max(0, e - length + 1) : e] = False
    found = [(none, none, none)]
    for s in range(0, len(whole), PIECE):  # the windows of a piece reach length - 1 bytes into the next
        begin, number, h = _picked(flat[s : s + PIECE + length - 1], whole[s : s + PIECE], length, width)
        found.append((begin + s, number, h))
    begin, number, h = (np.concatenate([f[k] for f in found]) for k in range(3))
    owner = np.searchsorted(ends, begin, "right")
    return owner, begin - starts[owner], number, h


def _picked(flat: np.ndarray, whole: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, number, hash) of the runs of windows of ``flat`` that ``whole`` admits and that have one anchor; under 2^24
    bytes."""
    n = len(flat)
    letters = np.random.default_rng(3).integers(1, 1 << 63, 256, np.uint64)
    h, size, total, done = letters[flat], 1, None, 0
    rest = width
    while rest:  # hashes of `width` bytes from those of 1, 2, 4 ... bytes
        if rest & 1:
            total = h.copy() if total is None else (total[: n - done - size + 1] * _U(0xD6E8FEB86659FD93) ^ (h[done:] + _U(0x632BE59BD9B4E019 * size & 0xFFFFFFFFFFFFFFFF)))
            done += size
        rest >>= 1
        if rest:
            h = h[: len(h) - size] * _U(0xFF51AFD7ED558CCD) ^ ((h[size:] >> _U(29)) + h[size:] * _U(0xC4CEB9FE1A85EC53))
            size *= 2
    total = (total ^ (total >> _U(32))) * _U(0x9E3779B97F4A7C15)
    total ^= total >> _U(29)
    places = _U(24)
    key = (total >> places << places) | np.arange(len(total), dtype=np.uint64)
    window, span = length - width + 1, 1
    low = key
    while 2 * span <= window:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[: n - length + 1], low[window - span : window - span + n - length + 1])
    window = np.flatnonzero(whole)
    at = low[window] & _U((1 << 24) - 1)
    if not len(at):
        return window, window, window
    head = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(window) != 1)]))
    return window[head], np.diff(head, append=len(at)), total[at[head]].view(np.int64)


def _parts(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with some MB of text each."""
    begin = size = 0
    for i, n in enumerate(pa.compute.binary_length(batch.column("text")).to_pylist()):
        size += n or 0
        if size >= most:
            yield batch.slice(begin, i + 1 - begin)
            begin, size = i + 1, 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _find(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                owner, begin, number, hashes = anchors([t or b"" for t in part.column("text").to_pylist()], length)
                at = pa.array(owner)
                yield pa.record_batch([pa.array(hashes, pa.int64()), part.column("id").take(at), part.column("sub").take(at), pa.array(begin << RUN_BITS | number)], names=["hash", "id", "sub", "run"])

    return run


_STRETCH = pa.schema([("hash", pa.int64()), ("id", pa.int64()), ("sub", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("content", pa.binary())])
STRETCH = "hash long, id long, sub long, begin int, end int, content binary"


def _cut(length: int) -> Callable:
    """The stretch of text that holds the strings of each repeated anchor.

    Of equal stretches in one partition only the earliest goes on; the others are repeated altogether and are given out
    as removed (without content).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[tuple[int, bytes], tuple] = {}
        removed: list[tuple] = []

        def flush(every: bool) -> pa.RecordBatch:
            rows = [(None, *p[1:], None) for p in removed]
            removed.clear()
            if every:
                rows += [(k[0], *p[1:], k[1]) for k, p in first.items()]
                first.clear()
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, _STRETCH)], schema=_STRETCH)

        for batch in batches:
            ids, subs, texts, marks = (batch.column(n) for n in ("id", "sub", "text", "marks"))
            ends = marks.offsets.to_numpy() - marks.offsets[0].as_py()
            runs, hashes = (marks.flatten().field(n).to_numpy() for n in ("run", "hash"))
            begins = runs >> RUN_BITS
            stops = (begins + (runs & ((1 << RUN_BITS) - 1)) + (length - 1)).tolist()
            begins, hashes = begins.tolist(), hashes.tolist()
            for id_, sub, text, a, b in zip(ids.to_pylist(), subs.to_pylist(), texts.to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                none = id_ is None
                for h, begin, end in zip(hashes[a:b], begins[a:b], stops[a:b]):
                    key, place = (h, text[begin:end]), (none, id_, sub, begin, end)
                    old = first.setdefault(key, place)
                    if old is place:
                        continue
                    if place[1:4] < old[1:4] if not (none or old[0]) else (none, sub, begin) < (old[0], old[2], old[3]):
                        removed.append(old)
                        first[key] = place
                    elif place != old:
                        removed.append(place)
                if len(first) > REMEMBERED or len(removed) > 50_000:
                    yield flush(len(first) > REMEMBERED)
        yield flush(True)

    return run


def _shard(length: int, queue_bytes: int = QUEUE_BYTES) -> Callable:
    """Places of a shard's repeated strings but the earliest, as spans."""
    schema = pa.schema([("id", pa.int64()), ("sub", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            raw, rows, first, whole = os.path.join(folder, "raw"), [], {}, []
            with open(raw, "wb") as file:
                for batch in batches:
                    for h, id_, sub, begin, end, content in zip(*(c.to_pylist() for c in batch.columns)):
                        # Equal stretches of different partitions: the earliest stands for all, as in _cut.
                        key, place = (h, xxhash.xxh3_128_digest(content)), (id_ is None, id_, sub, begin, end)
                        old = first.get(key)
                        if old is None:
                            file.write(content)
                            first[key] = (len(rows), place)
                            rows.append((h, id_, sub, begin, end))
                        elif place[:4] < old[1][:4]:
                            whole.append(old[1])
                            first[key] = (old[0], place)
                            rows[old[0]] = (h, id_, sub, begin, end)
                        elif place[:4] > old[1][:4]:
                            whole.append(place)
            first.clear()
            if whole:
                yield pa.record_batch([pa.array([p[k] for p in whole], f.type) for k, f in zip((1, 2, 3, 4), schema)], schema=schema)
            if not rows:
                return
            table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _STRETCH)], names=_STRETCH.names[:5])
            rows.clear()
            hashes, begin, end = (table.column(n).to_numpy() for n in ("hash", "begin", "end"))
            _, which, counts = np.unique(hashes, return_inverse=True, return_counts=True)
            live = counts[which] > 1
            if not live.any():
                return
            size = (end - begin).astype(np.int64)
            at = np.cumsum(size) - size
            text = os.path.join(folder, "text")
            with open(raw, "rb") as file, open(text, "wb") as out:
                for i in np.flatnonzero(live):
                    file.seek(at[i])
                    out.write(file.read(size[i]) + bytes([GAP]))
            os.remove(raw)
            size, begin = size[live], begin[live].astype(np.int64)
            starts = np.cumsum(size + 1) - size - 1
            # Documents in their order: by id, null last, then by content.
            keys = table.select(["id", "sub"]).filter(pa.array(live))
            known = keys.column("id").is_valid().to_numpy()
            ids, subs = keys.column("id").fill_null(0).to_numpy(), keys.column("sub").to_numpy()
            order = np.lexsort((subs, ids, ~known))
            fresh = np.concatenate([[False], (np.diff(ids[order]) != 0) | (np.diff(subs[order]) != 0) | (np.diff(known[order]) != 0)])
            doc = np.empty(len(order), np.int64)
            doc[order] = np.cumsum(fresh)
            sorter = InducedSorter(np.memmap(text, np.uint8, "r").view(np.ndarray), length, folder, queue_bytes)
            found = [_later(p, l, starts, size, begin, doc, length) for p, l in _groups(sorter.order(), length)]
            places = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
            if not len(places):
                return
            # Strings that overlap or touch in one document form one span.
            new = np.concatenate([[True], np.diff(places) > length])
            new[1:] |= (places[1:] >> 32) != (places[:-1] >> 32)
            a, b = places[new], places[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(places) - 1]])]
            back = np.empty(doc.max() + 1, np.int64)
            back[doc] = np.arange(len(doc))
            row = pa.array(back[a >> 32])
            low = (1 << 32) - 1
            yield pa.record_batch([keys.column("id").take(row).combine_chunks(), keys.column("sub").take(row).combine_chunks(), pa.array(a & low, pa.int32()), pa.array((b & low) + length, pa.int32())], schema=schema)

    return run


def _groups(parts: Iterator[tuple[np.ndarray, np.ndarray]], length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes that share ``length`` bytes with a neighbour, never cut inside a run of equals."""
    pos, lcp = np.zeros(0, np.int64), np.zeros(0, np.uint8)
    for p, l in parts:
        pos, lcp = np.concatenate([pos, p]), np.concatenate([lcp, l])
        cut = np.flatnonzero(lcp < length)
        if len(cut) and cut[-1]:
            yield pos[: cut[-1]], lcp[: cut[-1]]
            pos, lcp = pos[cut[-1] :], lcp[cut[-1] :]
    yield pos, lcp


def _later(pos: np.ndarray, lcp: np.ndarray, starts: np.ndarray, size: np.ndarray, begin: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """(document << 32 | place) of all but the earliest of each run of equal strings."""
    joins = lcp >= length
    if not len(pos):
        return pos
    joins[0] = False
    part = joins | np.append(joins[1:], False)
    pos, joins = pos[part], joins[part]
    if not len(pos):
        return pos
    stretch = np.searchsorted(starts, pos, "right") - 1
    offset = pos - starts[stretch]
    # Runs never reach over a gap: a string with one inside differs from all others, or is no string of the text.
    inside = offset + length <= size[stretch]
    place = (doc[stretch] << 32) | (begin[stretch] + offset)
    place = np.where(inside, place, np.int64(1) << 62)
    heads = np.flatnonzero(~joins)
    least = np.repeat(np.minimum.reduceat(place, heads), np.diff(np.append(heads, len(place))))
    return place[inside & (place > least)]


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the spans of each text and cut them out."""
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), ("kept", pa.binary())])
    for batch in batches:
        for part in _parts(batch):
            out = []
            for id_, text, spans in zip(*(part.column(n).to_pylist() for n in ("id", "text", "spans"))):
                text, merged, kept, at = text or b"", [], [], 0
                for s in sorted(spans or [], key=lambda s: s["begin"]):
                    if merged and s["begin"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                    else:
                        merged.append(dict(s))
                for s in merged:
                    kept.append(text[at : s["begin"]])
                    at = s["end"]
                out.append((id_, len(text), merged, b"".join([*kept, text[at:]])))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, schema)], schema=schema)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES, queue_bytes: int = QUEUE_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``spans`` (begin, end of what is repeated), ``kept`` (the rest).

    A byte is repeated if it lies in a string of ``length`` bytes that also starts earlier, in a smaller id or earlier in
    the same text. Bytes are those of UTF-8, so ``kept`` is binary.

    Edge cases: null text counts as empty; ids that are null come last and, as rows that share an id, are ordered by a
    hash of their text; rows that share id and text count as one document, alike in their results; texts shorter than
    ``length`` lose nothing; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("sub", F.xxhash64("text"))
    # Each step is written, so that what it shuffled is gone before the next one begins. Marks and spans are sets: rows that
    # share id and text have the same ones, and each of these rows gets them all.
    marks = stored(rows.mapInArrow(_find(length), "hash long, id long, sub long, run long"), "marks")
    often = stored(marks.groupBy("hash").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("hash"), "marks-often")
    owned = stored(marks.join(often, "hash").groupBy("id", "sub").agg(F.collect_set(F.struct("run", "hash")).alias("marks")), "marks-owned")
    near = rows.alias("r").join(owned.alias("o"), (F.col("r.id").eqNullSafe(F.col("o.id"))) & (F.col("r.sub") == F.col("o.sub")))
    near = near.select("r.id", "r.sub", "r.text", "o.marks")
    stretches = stored(near.mapInArrow(_cut(length), STRETCH), "stretches")
    release(marks, often, owned)
    sent = stretches.filter(F.col("content").isNotNull())
    total = sent.agg(F.coalesce(F.sum(F.length("content")), F.lit(0))).first()[0]
    shards = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // shard_bytes))
    found = sent.repartition(int(shards), "hash").mapInArrow(_shard(length, queue_bytes), "id long, sub long, begin int, end int")
    spans = stretches.filter(F.col("content").isNull()).select("id", "sub", "begin", "end").union(found)
    spans = stored(spans.groupBy("id", "sub").agg(F.collect_set(F.struct("begin", "end")).alias("spans")), "spans")
    release(stretches)
    out = rows.alias("r").join(spans.alias("s"), F.col("r.id").eqNullSafe(F.col("s.id")) & (F.col("r.sub") == F.col("s.sub")), "left").select("r.id", "r.text", "s.spans")
    return out.mapInArrow(_keep, "id long, n_bytes long, spans array<struct<begin:int,end:int>>, kept binary").withColumnRenamed("id", id_col)
