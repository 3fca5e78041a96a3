"""Packing token sequences by bounded-space online best fit.

Each partition keeps a fixed number of open windows. A document goes into the fullest window it fits in; when it fits
in none, its beginning tops up the fullest window, which is then emitted. Windows left open are merged at the end.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .near_dedup import run_hashes
from .shared import fresh, stored, text_pieces

TOKENIZER = "word_bpe_49k.json"
#: Tokens of a sequence; windows a partition keeps open; id that ends each document.
WINDOW, OPEN, END_ID = 2048, 32, 1
#: Partitions whose open windows are merged together. Each leaves OPEN at most, so a merge is bounded.
MERGED = 32
#: Word pieces kept for reuse in a task; bytes of text worked on at once.
CACHE, SLICE = 200_000, 1 << 20

PIECES = "doc_row long, start long, length long, doc_tokens long, sequence_id long, offset long, ids array<int>"
_SCHEMA = pa.schema([("doc_row", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))])


@cache
def _encoder(path: str, by_words: bool) -> WordEncoder:
    """One for each Python worker, so that later tasks find the pieces of earlier ones."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; idle threads would spin on it
    return WordEncoder(path, by_words)


#: What a byte of UTF-8 is to the tokenizer: white space, part of a letter, a digit, a mark; or odd, if only the tokenizer
#: itself can tell. All letters from U+00C0 to U+024F are written with the leading bytes C3 to C9.
BLANK, LETTER, DIGIT, MARK, ODD = range(5)


def _classes() -> np.ndarray:
    out = np.full(256, ODD, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = BLANK
    out[33:127] = MARK
    out[48:58] = DIGIT
    for a, b in ((65, 91), (97, 123), (0x80, 0xC0), (0xC3, 0xCA)):
        out[a:b] = LETTER
    return out


class WordEncoder:
    """The default tokenizer's ids of whole texts; each distinct piece of a batch is looked up or encoded once.

    The tokenizer lower-cases and treats pieces apart: runs of letters, single digits, runs of other marks, and the
    contractions 's 't 'm 'd 're 've 'll. Pieces are found in the bytes of a batch of texts at once. Words outside plain
    Latin text go through the tokenizer as they are. With ``by_words=False``, which fits any tokenizer, every text does.
    """

    CLASSES = _classes()

    def __init__(self, path: str, by_words: bool = True) -> None:
        self.whole, self.by_words = Tokenizer.from_file(path), by_words
        self.pieces = Tokenizer(self.whole.model)
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that end a piece
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[int, bytes] = {}
        self.older: dict[int, bytes] = {}

    @staticmethod
    def _encoded(tokenizer: Tokenizer, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(texts), 20_000):
            out += [array("i", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts[i : i + 20_000], add_special_tokens=False)]
        return out

    def _joined(self, parts: list[str]) -> list[bytes]:
        """Ids of each piece; many go through the tokenizer as one text and are told apart by the ids that end pieces."""
        out: list[bytes] = []
        for i in range(0, len(parts), 20_000):
            some = parts[i : i + 20_000]
            ids = np.array(self.pieces.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int32)
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            flat = ids.tobytes()
            out += [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])] if len(cuts) == len(some) + 1 else self._encoded(self.pieces, some)
        return out

    def find_pieces(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of some texts, plain words lower-cased; begin and end of each piece; which go through the tokenizer."""
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        kind = self.CLASSES[raw]
        full = kind != BLANK
        upper = np.concatenate([[False], full[:-1]])
        words = np.flatnonzero(full & ~upper)
        # Words with an odd byte, a multiplication or division sign, a dotted capital I, or the beginning of a special token.
        odd = kind == ODD
        odd[:-1] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)) | (raw[:-1] == 0xC4) & (raw[1:] == 0xB0) | (raw[:-1] == 60) & (raw[1:] == 124)
        word_odd = np.zeros(len(words), bool)
        word_odd[np.searchsorted(words, np.flatnonzero(odd), "right") - 1] = True
        flat = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
        start = full & ((kind != np.concatenate([[BLANK], kind[:-1]])) | (kind == DIGIT))
        for mark in np.flatnonzero(start & (raw == 39)).tolist():  # an apostrophe that begins a piece
            two = flat[mark + 1 : mark + 3].tobytes()
            n = 2 if two in (b"re", b"ve", b"ll") else 1 if two[:1] in (b"s", b"t", b"m", b"d") else 0
            if n:
                start[mark + 1] = False
                start[mark + 1 + n] |= bool(kind[mark + 1 + n] == LETTER)
        where = np.flatnonzero(word_odd)
        if len(where):
            ends = np.flatnonzero(upper & ~full)
            for w in where.tolist():
                start[words[w] + 1 : ends[w]] = False
                flat[words[w] : ends[w]] = raw[words[w] : ends[w]]
        begin = np.flatnonzero(start)
        stops = start.copy()
        stops |= ~full & upper
        stop = np.flatnonzero(stops)
        end = stop[np.searchsorted(stop, begin, "right")]
        whole = np.zeros(len(begin), bool)
        whole[np.searchsorted(begin, words[where])] = True
        return flat, begin, end, whole

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.by_words:
            return [np.frombuffer(x, np.int32) for x in self._encoded(self.whole, [t.decode("utf-8", "replace") for t in texts])]
        if len(self.known) > CACHE:  # pieces not met again until the next time are forgotten
            self.older, self.known = self.known, {}
        flat, begin, end, whole = self.find_pieces(texts)
        hashes = run_hashes(flat, begin, end) ^ np.where(whole, np.uint64(0x5851F42D4C957F2D), np.uint64(0))
        distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        ids = list(map(self.known.get, keys))
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            new = []
            for i in missing:
                old = self.older.get(keys[i])
                if old is None:
                    new.append(i)
                else:
                    ids[i] = self.known[keys[i]] = old
            body = flat.tobytes()
            at = first[new]
            text = [body[a:b].decode("utf-8", "replace") for a, b in zip(begin[at].tolist(), end[at].tolist())]
            odd = whole[at].tolist()
            plain = iter(self._joined([t.lower() for t, o in zip(text, odd) if not o]))
            other = iter(self._encoded(self.whole, [t for t, o in zip(text, odd) if o]))
            for i, o in zip(new, odd):
                ids[i] = self.known[keys[i]] = next(other if o else plain)
        sizes = np.array(list(map(len, ids)), np.int64) >> 2
        from_ = np.cumsum(sizes) - sizes
        count = sizes[place]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) + np.repeat(from_[place] - (ends - count), count)
        out = np.frombuffer(b"".join(ids), np.int32)[source]
        borders = np.searchsorted(begin, np.cumsum([len(t) + 1 for t in texts]))
        return np.split(out, np.concatenate([[0], ends])[borders][:-1])


class OpenWindows:
    """Windows being filled; each is a list of pieces (row, start, ids, document's tokens)."""

    def __init__(self, window: int, most: int) -> None:
        self.window, self.most, self.open = window, most, []  # of [tokens, pieces]

    def place(self, row: int, ids: np.ndarray) -> Iterator[list]:
        """Place a whole document; yields the pieces of each window that is full."""
        start, total = 0, len(ids)
        while total - start >= self.window:
            yield [(row, start, ids[start : start + self.window], total)]
            start += self.window
        while start < total:
            left = total - start
            fits = [w for w in self.open if w[0] + left <= self.window]
            if fits:
                best, n = max(fits, key=lambda w: w[0]), left
            elif len(self.open) < self.most:
                self.open.append(best := [0, []])
                n = left
            else:
                best = max(self.open, key=lambda w: w[0])
                n = self.window - best[0]
            best[0] += n
            best[1].append((row, start, ids[start : start + n], total))
            start += n
            if best[0] == self.window:
                self.open.remove(best)
                yield best[1]


class _Pieces:
    """Pieces of finished windows as Arrow batches."""

    def __init__(self) -> None:
        self.rows, self.tokens = [], 0

    def add(self, sequence: int, pieces: list) -> Iterator[pa.RecordBatch]:
        offset = 0
        for row, start, ids, total in pieces:
            self.rows.append((row, start, len(ids), total, sequence, offset, ids))
            offset += len(ids)
        self.tokens += offset
        if self.tokens >= 1 << 20:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [[] for _ in range(7)]
        ids = columns[6]
        offsets = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        flat = np.concatenate(ids).astype(np.int32) if len(ids) else np.zeros(0, np.int32)
        arrays = [pa.array(list(c), pa.int64()) for c in columns[:6]] + [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
        self.rows, self.tokens = [], 0
        return pa.record_batch([a.cast(f.type) for a, f in zip(arrays, _SCHEMA)], schema=_SCHEMA)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Rows with about SLICE bytes of text each; longer texts come in pieces, of which the last has the row, as a tuple."""
    rows, texts, size = [], [], 0
    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            pieces = list(text_pieces(text or b"", SLICE))
            for k, piece in enumerate(pieces):
                rows.append((row,) if k == len(pieces) - 1 else None)
                texts.append(piece)
                size += len(piece)
                if size >= SLICE or len(rows) >= 4096:
                    yield rows, texts
                    rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _pack(path: str, by_words: bool, window: int, most: int, end_id: int | None) -> Callable:
    """Tokenize and pack one partition. Sequences it leaves open get negative ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        encoder, windows, out, done, held = _encoder(path, by_words), OpenWindows(window, most), _Pieces(), 0, []
        end = np.array([] if end_id is None else [end_id], np.int32)
        for rows, texts in _slices(batches):
            for row, ids in zip(rows, encoder.encode(texts)):
                held.append(ids)
                if row is None:  # a piece of a longer text
                    continue
                ids = np.concatenate([*held, end])
                held.clear()
                for pieces in windows.place(row[0], ids):
                    yield from out.add(first + done, pieces)
                    done += 1
        for k, (_, pieces) in enumerate(windows.open):
            yield from out.add(-1 - first - k, pieces)
        yield out.flush()

    return run


def _merge(window: int) -> Callable:
    """Fill the open windows of some partitions into full ones; only the last may stay short."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        out, batches, pieces, room, done = _Pieces(), [], [], window, 0
        first = (1 << 62) + (int(key[0]) << 32)
        names = ["doc_row", "start", "doc_tokens"]
        table = table.sort_by([("sequence_id", "descending"), ("offset", "ascending")])
        for row, start, total, ids in zip(*(table.column(n).to_pylist() for n in names), table.column("ids").to_pylist()):
            ids, at = np.array(ids, np.int32), 0
            while at < len(ids):
                n = min(room, len(ids) - at)
                pieces.append((row, start + at, ids[at : at + n], total))
                room, at = room - n, at + n
                if not room:
                    batches += out.add(first + done, pieces)
                    pieces, room, done = [], window, done + 1
        if pieces:
            batches += out.add(first + done, pieces)
        return pa.Table.from_batches([*batches, out.flush()])

    return run


def pack(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, open_windows: int = OPEN, end_id: int | None = END_ID, by_words: bool = True, merged: int = MERGED) -> DataFrame:
    """Pack all texts into sequences of at most ``window`` tokens; one row per piece, with its token ids.

    Columns: all of ``docs`` but the text, ``start`` (the document's tokens before the piece), ``length``,
    ``doc_tokens``, ``sequence_id``, ``offset`` and ``ids``. Every token lies in exactly one piece, the pieces of a
    sequence follow each other without gaps, and only the last sequence of each merge of ``merged`` partitions is
    shorter than the window. ``tokenizer``: path of a file of the tokenizers library.

    Edge cases: null and empty texts hold only the end token (nothing if ``end_id`` is None: then no row); texts of any
    length are cut; repeated rows are packed each; an empty table gives an empty one; columns of ``docs`` named
    like a result are dropped.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    results = ("start", "length", "doc_tokens", "sequence_id", "offset", "ids")
    keep = [c for c in docs.columns if c != text_col and c.lower() not in results]
    (row,) = fresh(docs, "doc_row")
    if len(keep) == 1 and dict(docs.dtypes)[keep[0]] == "bigint":
        source, payload = docs.select(F.col(keep[0]).alias(row), F.col(text_col).cast("binary").alias("text")), None
    else:  # other columns meet their pieces by a row number that is written down first
        source = stored(docs.select(F.monotonically_increasing_id().alias(row), *keep, F.col(text_col).cast("binary").alias("text")), "pack-rows")
        source, payload = source.select(row, "text"), source.select(row, *keep)
    pieces = source.mapInArrow(_pack(path, by_words, window, open_windows, end_id), PIECES)
    pieces = stored(pieces, "pack-pieces")
    whole = pieces.filter(F.col("sequence_id") >= 0)
    left = pieces.filter(F.col("sequence_id") < 0)
    group = F.floor(F.shiftright(-1 - F.col("sequence_id"), 32) / merged).cast("long")
    rest = left.groupBy(group.alias("group")).applyInArrow(_merge(window), PIECES)
    out = whole.unionByName(rest)
    if payload is None:
        return out.select(F.col("doc_row").alias(keep[0]), *results)
    return payload.join(out.withColumnRenamed("doc_row", row), row).select(*keep, *results)
