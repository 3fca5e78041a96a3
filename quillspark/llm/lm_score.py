"""Language-model scoring by logistic context mixing, in bits.

A text is coded word by word. A first bit says whether the word is the one that most often followed the two words before
it in the training texts; its probability is refined by how sure that context is and by how long such predictions have
held. A word that isn't predicted is spelled along a Huffman tree: contexts of the last one, two and three bytes and of
the whole beginning of the word each predict a bit from what followed them, a gate picks the weights that mix the
predictions in the logistic domain, and a table indexed by tree node and mixed prediction refines the result. Weights and
refinement are learned online over the training words. Beside it stands a plain unigram score of the words.

Nothing of the corpus is held whole anywhere: words are a Spark table, contexts of words go to the tasks of their hash
ranges, both as packed arrays a block of texts at a time, and the answers come back to the blocks.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .near_dedup import words_of
from .shared import release, stored, text_pieces

END, PAD, PADS = 256, 257, 3
#: Letter contexts: preceding bytes of a word, and the bits of their table's slots. A context of three bytes has a
#: bounded number of values, so these tables need not grow; the beginnings of words (more than PADS bytes) do.
ORDERS, TABLE_BITS = (1, 2, 3), (17, 20, 22)
SLOTS = sum(1 << b for b in TABLE_BITS)
SLICES = 32
PREDICTORS, GATES, LEVELS, LIMIT = 4, 16, 33, 8.0
RATE, STEP = 0.3, 1 << 12
#: Words of a chunk of the letter model, which keeps together those that share their first bytes; words worked on at once;
#: the number of first bytes. Words a partition holds.
CHUNK_WORDS, SLICE_WORDS, TOGETHER = 15_000, 20_000, 4
PARTITION_WORDS = 300_000
#: Bytes of text hashed at once and of a block; rows of words and of tokens aimed at in a hash range.
PART_BYTES, BLOCK_BYTES = 1 << 18, 4 << 20
RANGE_WORDS, RANGE_TOKENS = 1 << 20, 1 << 20
#: How often the predicted word has followed, and other words: steps of the table of word predictions; and of the run of
#: predictions that held.
FOLLOWED, OTHERS, RUNS = (2, 3, 5, 9, 17, 65), (1, 2, 4, 9, 33), (1, 2, 4, 8)
CELLS = (1 + (len(FOLLOWED) + 1) * (len(OTHERS) + 1)) * (len(RUNS) + 1)

_U = np.uint64


@dataclass
class Coder:
    """Huffman codes of the 256 bytes and the end: length, bits and tree nodes on the way, padded."""

    length: np.ndarray
    bits: np.ndarray
    nodes: np.ndarray

    @staticmethod
    def fit(counts: np.ndarray) -> Coder:
        heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        children, n = {}, len(counts)
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            children[n] = (x, y)
            heapq.heappush(heap, (a + b, n, n))
            n += 1
        codes: list[list[tuple[int, int]]] = [[] for _ in counts]
        stack: list[tuple[int, list]] = [(n - 1, [])]
        while stack:
            node, path = stack.pop()
            if node < len(counts):
                codes[node] = path
            else:
                for bit, child in enumerate(children[node]):
                    stack.append((child, [*path, (node - len(counts), bit)]))
        width = max(map(len, codes))
        fill = lambda k: np.array([[p[k] for p in c] + [0] * (width - len(c)) for c in codes], np.uint8)
        return Coder(np.array([len(c) for c in codes]), fill(1), fill(0))


# --- letters ---------------------------------------------------------------------------------------------------------

def stream(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of some words, each after PADS paddings and before its end, and the word number of each."""
    sizes = np.array([len(w) for w in words]) + PADS + 1
    out = np.full(sizes.sum(), PAD, np.uint16)
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(out)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    body = (place >= PADS) & (place < np.repeat(sizes - 1, sizes))
    out[body] = np.frombuffer(b"".join(words), np.uint8)
    out[np.cumsum(sizes) - 1] = END
    return out, owner


class Bits:
    """The coded bits of some words: word, node and bit, the slots of the letter tables, and a key of the word's
    beginning with the node."""

    def __init__(self, coder: Coder, words: list[bytes]) -> None:
        symbols, owner = stream(words)
        scored = np.flatnonzero(symbols != PAD)
        symbol = symbols[scored]
        length = coder.length[symbol]
        which = np.repeat(np.arange(len(scored), dtype=np.int32), length)
        step = np.arange(len(which)) - np.repeat(np.cumsum(length) - length, length)
        symbol = symbol[which]
        self.node, self.bit, self.owner = coder.nodes[symbol, step], coder.bits[symbol, step], owner[scored][which]
        node = self.node.astype(np.uint64)
        s = symbols.astype(np.uint64)
        context, begin, self.slots = np.zeros(len(scored), np.uint64), 0, []
        for order, bits in zip(ORDERS, TABLE_BITS):
            context = context * _U(258) + s[scored - order]
            if order == 1:
                slot = (context[which] << _U(8)) + node
            else:
                slot = ((context * _U(0x9E3779B97F4A7C15))[which] + node * _U(0xC2B2AE3D27D4EB4F)) * _U(0xD6E8FEB86659FD93) >> _U(64 - bits)
            self.slots.append(slot.astype(np.int64) + begin)
            begin += 1 << bits
        # A hash of all letters of the word so far, by running sums. Where it has fewer than TOGETHER letters, words that
        # share them may be in other chunks; there the last three symbols, paddings included, stand for the beginning.
        first = np.cumsum([0] + [len(w) + PADS + 1 for w in words[:-1]])
        place = np.arange(len(s)) - first[owner]
        powers = np.cumprod(np.full(256, 0x100000001B3, np.uint64), dtype=np.uint64)
        total = np.cumsum((s + _U(1)) * powers[place & 255] + place.astype(np.uint64), dtype=np.uint64)
        self.early = (place[scored] < PADS + TOGETHER)[which]
        sofar = total[scored - 1] - total[first][owner[scored]]
        self.beginning = ((sofar * _U(0xFF51AFD7ED558CCD))[which] + node * _U(0x9E3779B97F4A7C15)) * _U(0xC4CEB9FE1A85EC53)

    def inputs(self, table: np.ndarray, begun: Begun, counts: np.ndarray, left_out: bool) -> tuple[list[np.ndarray], np.ndarray]:
        """Stretched predictions of each context, and the gate. counts: how often each word occurs in training texts;
        ``left_out``: as if one of these occurrences, the one that is coded, weren't among the counts."""
        x, gate = [], None
        own = (counts > 0)[self.owner] if left_out else None
        for k in range(PREDICTORS):
            zeros, ones = (table[self.slots[min(k, PADS - 1)], b] for b in (0, 1))
            if k == len(ORDERS):
                late = np.flatnonzero(~self.early)
                at = np.searchsorted(begun.keys, self.beginning[late])
                zeros[late], ones[late] = begun.seen[0][at], begun.seen[1][at]
            if left_out:
                zeros, ones = np.maximum(zeros - (own & (self.bit == 0)), 0), np.maximum(ones - (own & (self.bit == 1)), 0)
            stretch = np.clip(np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4))), -LIMIT, LIMIT)
            x.append(stretch.astype(np.float32))
            if k >= PREDICTORS - 2:
                sure = np.searchsorted(np.array([1, 4, 32], np.float32), zeros + ones, "right").astype(np.uint8)
                gate = sure if gate is None else gate * np.uint8(4) + sure
        return x, gate


@dataclass
class Begun:
    """What followed each beginning of a chunk's words, by sorted key."""

    keys: np.ndarray
    seen: list[np.ndarray]

    @staticmethod
    def of(parts: Iterator[tuple[Bits, np.ndarray]]) -> Begun:
        keys, seen = [np.zeros(0, np.uint64)], [np.zeros((2, 0))]
        for bits, counts in parts:
            late = np.flatnonzero(~bits.early)
            key, where = np.unique(bits.beginning[late], return_inverse=True)
            weight, bit = counts[bits.owner[late]], bits.bit[late]
            keys.append(key)
            seen.append(np.stack([np.bincount(where, weight * (bit == b), minlength=len(key)) for b in (0, 1)]))
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        return Begun(key, [np.bincount(where, np.concatenate([x[b] for x in seen]), minlength=len(key)).astype(np.float32) for b in (0, 1)])


def _by_slice(coder: Coder, words: list[bytes], counts: np.ndarray) -> tuple[Begun, Iterator[tuple[slice, Bits]]]:
    """The beginnings of a chunk, and its bits for some words at a time, made anew where there are many."""
    places = [slice(i, i + SLICE_WORDS) for i in range(0, len(words), SLICE_WORDS)]
    if len(places) == 1:
        bits = Bits(coder, words)
        return Begun.of(iter([(bits, counts)])), iter([(places[0], bits)])
    begun = Begun.of((Bits(coder, words[at]), counts[at]) for at in places)
    return begun, ((at, Bits(coder, words[at])) for at in places)


@dataclass
class Mixer:
    coder: Coder
    slices: list[bytes]  # of the letter tables, packed, as they are sent
    weights: np.ndarray  # predictors + 1 x GATES
    refined: np.ndarray  # nodes x LEVELS

    @staticmethod
    def fresh(coder: Coder, slices: list[bytes]) -> Mixer:
        weights = np.full((PREDICTORS + 1, GATES), 0.35, np.float32)
        weights[-1] = 0
        return Mixer(coder, slices, weights, np.tile(np.linspace(-LIMIT, LIMIT, LEVELS, dtype=np.float32), (256, 1)))

    @cached_property
    def table(self) -> np.ndarray:
        """slots x (zeros, ones)"""
        return np.concatenate([np.frombuffer(zlib.decompress(d), np.float32).reshape(2, -1).T for d in self.slices])

    def mixed(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        z = self.weights[-1][gate]
        for w, v in zip(self.weights, x):
            z += w[gate] * v
        return np.clip(z, -LIMIT, LIMIT, out=z)

    @staticmethod
    def level(z: np.ndarray) -> np.ndarray:
        return np.rint((z + np.float32(LIMIT)) * np.float32((LEVELS - 1) / (2 * LIMIT))).astype(np.int64)

    def probabilities(self, bits: Bits, begun: Begun, counts: np.ndarray) -> np.ndarray:
        """How likely each coded bit is to be 1."""
        z = self.mixed(*bits.inputs(self.table, begun, counts, False))
        z += self.refined[bits.node, self.level(z)]
        return 1 / (1 + np.exp(z * np.float32(-0.5)))

    def spelled(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Bits that spelling each word takes."""
        out = [np.zeros(0)]
        begun, slices = _by_slice(self.coder, words, counts)
        for at, bits in slices:
            p = self.probabilities(bits, begun, counts[at])
            out.append(np.bincount(bits.owner, -np.log2(np.where(bits.bit, p, 1 - p)), minlength=len(words[at])))
        return np.concatenate(out)


# --- packed arrays ---------------------------------------------------------------------------------------------------

def _packed(x: np.ndarray, width: int = 8) -> bytes:
    """Whole numbers, byte by byte of their value, which packs better."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), 1)


def _unpacked(data: bytes, width: int = 8) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, :width] = flat.T
    return out.view("<u8").ravel()


def _rising(x: np.ndarray, width: int = 8) -> bytes:
    return _packed(np.diff(x, prepend=x.dtype.type(0)), width)


def _risen(data: bytes, width: int = 8) -> np.ndarray:
    return np.cumsum(_unpacked(data, width), dtype=np.uint64)


# --- blocks of texts -------------------------------------------------------------------------------------------------

_BLOCK = pa.schema([
    ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("trains", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("tokens", pa.int64()),
    ("vocabulary", pa.binary()), ("places", pa.binary()), ("counts", pa.binary()), ("spelled", pa.binary()),
])
BLOCK = "block long, ids array<long>, trains array<boolean>, sizes array<long>, tokens long, vocabulary binary, places binary, counts binary, spelled binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts: each word's hash once, the more frequent ones first, and the place of every word in that list."""
    from pyspark import TaskContext

    number, rows, parts, waiting, size, held = TaskContext.get().partitionId() << 32, [], [], [], 0, 0

    def hashed() -> None:
        flat, starts, sizes, hashes, owner = words_of([p for _, p in waiting])
        new, first = np.unique(hashes, return_index=True)
        body = flat.tobytes()
        words = [body[a : a + n] for a, n in zip(starts[first].tolist(), sizes[first].tolist())]
        parts.append((hashes, np.array([r for r, _ in waiting], np.int64)[owner], new, words))
        waiting.clear()

    def flush() -> pa.RecordBatch:
        hashes, owner = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        vocabulary, places, seen = np.unique(hashes, return_inverse=True, return_counts=True)
        spelled = np.empty(len(vocabulary), object)
        for _, _, new, words in parts:
            spelled[np.searchsorted(vocabulary, new)] = words
        order = np.argsort(-seen, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        places = rank[places]
        trains = np.array([r[1] for r in rows])
        counts = np.bincount(places, trains[owner], minlength=len(order)).astype(np.uint64)
        columns = [[number], [[r[0] for r in rows]], [trains.tolist()], [np.bincount(owner, minlength=len(rows)).tolist()], [len(places)], [vocabulary[order].tobytes()], [_packed(places, 4)], [_packed(counts)], [zlib.compress(b"\n".join(spelled[order].tolist()), 1)]]
        parts.clear()
        rows.clear()
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _BLOCK)], schema=_BLOCK)

    for batch in batches:
        for id_, text, trains in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "trains"))):
            for piece in text_pieces(text, PART_BYTES):
                waiting.append((len(rows), piece))
                held += len(piece)
                if held >= PART_BYTES or len(waiting) >= 4096:
                    hashed()
                    held = 0
            rows.append((id_, trains))
            size += len(text) + 8
            if size >= BLOCK_BYTES:
                hashed()
                yield flush()
                number, size, held = number + 1, 0, 0
    if rows:
        hashed()
        yield flush()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, word, n) of the words of blocks."""
    for batch in batches:
        for vocabulary, counts, spelled in zip(*(batch.column(c).to_pylist() for c in ("vocabulary", "counts", "spelled"))):
            keys, n = np.frombuffer(vocabulary, np.int64), _unpacked(counts).astype(np.int64)
            words = zlib.decompress(spelled).split(b"\n") if len(keys) else []
            yield pa.record_batch([pa.array(keys), pa.array(words, pa.binary()), pa.array(n)], names=["key", "word", "n"])


def _contexts(vocabulary: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every token the hash of the two words before it in its text, and 24 bits of its own word."""
    h = vocabulary[places]
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(h)) - np.repeat(begin, sizes)
    one, two = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
    one[1:], two[2:] = h[:-1], h[:-2]
    one[place < 1], two[place < 2] = _U(1), _U(2)
    x = (one ^ (one >> _U(31))) * _U(0x9E3779B97F4A7C15) + (two ^ (two >> _U(29))) * _U(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29)), h >> _U(40)


def _split(x: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(range, begin, end) of sorted hashes by their leading bits, ranges that have some."""
    part = (x >> _U(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(x)]):
        yield int(part[a]), a, b


ASK = "block long, part long, data binary"


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.binary()))], names=["block", "part", "data"])


def _ask_words(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, vocabulary in zip(*(batch.column(c).to_pylist() for c in ("block", "vocabulary"))):
                x = np.sort(np.frombuffer(vocabulary, np.uint64))
                yield _rows([(block, part, _rising(x[a:b])) for part, a, b in _split(x, bits)])

    return run


def _ask_contexts(bits: int) -> Callable:
    """Per block and range the sorted contexts (32 bits within the range), the words that followed, which of them train."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, vocabulary, places, sizes, trains in zip(*(batch.column(c).to_pylist() for c in ("block", "vocabulary", "places", "sizes", "trains"))):
                sizes = np.array(sizes, np.int64)
                x, word = _contexts(np.frombuffer(vocabulary, np.uint64), _unpacked(places, 4).astype(np.int64), sizes)
                order = np.argsort(x, kind="stable")
                x, word, trains = x[order], word[order], np.repeat(np.array(trains), sizes)[order]
                low = x << _U(bits) >> _U(32)
                out = []
                for part, a, b in _split(x, bits):
                    packed = [_rising(low[a:b], 4), _packed(word[a:b], 3), zlib.compress(np.packbits(trains[a:b]).tobytes(), 1)]
                    out.append((block, part, b"".join([np.array([b - a, *map(len, packed)], "<u4").tobytes(), *packed])))
                yield _rows(out)

    return run


def _read_asked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, a, b, _ = np.frombuffer(data[:16], "<u4").tolist()
    trains = np.unpackbits(np.frombuffer(zlib.decompress(data[16 + a + b :]), np.uint8))[:n].astype(bool)
    return _risen(data[16 : 16 + a], 4), _unpacked(data[16 + a : 16 + a + b], 3), trains


def followers(context: np.ndarray, word: np.ndarray, trains: np.ndarray) -> np.ndarray:
    """For each token 0 if its context predicts nothing, else 2 x cell + hit (is it the word predicted).

    A context predicts the word that followed it most often in training (of several, the one of least hash). A training
    token is judged as if it weren't among the counts itself.
    """
    out = np.zeros(len(context), np.uint8)
    key = context << _U(24) | word
    order = np.argsort(key)
    key, own = key[order], trains[order].astype(np.int64)
    head = np.flatnonzero(np.diff(key >> _U(24), prepend=_U(1) << _U(63)))
    size = np.diff(head, append=len(key))
    live = np.repeat(size > 1, size)  # what occurs once, nothing else can tell of
    order, key, own = order[live], key[live], own[live]
    if not len(key):
        return out
    run = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    n = np.add.reduceat(own, run)
    groups = np.flatnonzero(np.diff(key[run] >> _U(24), prepend=_U(1) << _U(63)))
    of_run = np.repeat(np.arange(len(groups)), np.diff(groups, append=len(run)))
    of = np.repeat(of_run, np.diff(run, append=len(key)))
    rank = n.astype(np.uint64) << _U(24) | (_U((1 << 24) - 1) - (key[run] & _U((1 << 24) - 1)))
    best = np.maximum.reduceat(rank, groups)
    second = np.maximum.reduceat(np.where(rank == best[of_run], 0, n), groups)
    total, first = np.add.reduceat(n, groups), (best >> _U(24)).astype(np.int64)
    hit = (key & _U((1 << 24) - 1)) == (_U((1 << 24) - 1) - (best & _U((1 << 24) - 1)))[of]
    times = first[of] - (hit & (own > 0))
    overtaken = hit & (times < second[of])
    times = np.where(overtaken, second[of], times)
    hit &= ~overtaken
    others = total[of] - own - times
    cell = 1 + np.searchsorted(FOLLOWED, times, "right") * (len(OTHERS) + 1) + np.searchsorted(OTHERS, others, "right")
    out[order] = np.where(times > 0, 2 * cell + hit, 0)
    return out


def _answer_contexts(key: tuple, table: pa.Table) -> pa.Table:
    blocks, asked = table.column("block").to_pylist(), [_read_asked(d) for d in table.column("data").to_pylist()]
    found = followers(*(np.concatenate([a[k] for a in asked]) for k in range(3)))
    ends = np.cumsum([len(a[0]) for a in asked])
    data = [zlib.compress(x.tobytes(), 1) for x in np.split(found, ends[:-1])]
    return pa.table({"block": pa.array(blocks, pa.int64()), "kind": pa.array([1] * len(blocks), pa.int32()), "part": pa.array([key[0]] * len(blocks), pa.int64()), "data": pa.array(data, pa.binary())})


def _answer_words(key: tuple, asked: pa.Table, words: pa.Table) -> pa.Table:
    """How often each asked word occurs in training texts, and what spelling it takes."""
    keys, n, bits = (words.column(c).to_numpy() for c in ("key", "n", "bits"))
    order = np.argsort(keys.view(np.uint64))
    keys, n, bits = keys[order].view(np.uint64), n[order], bits[order]
    data = []
    for d in asked.column("data").to_pylist():
        at = np.searchsorted(keys, _risen(d))
        data.append(np.array([len(x := _packed(n[at].astype(np.uint64)))], "<u4").tobytes() + x + _packed(bits[at].astype(np.float32).view(np.uint32), 4))
    m = len(data)
    return pa.table({"block": asked.column("block"), "kind": pa.array([0] * m, pa.int32()), "part": asked.column("part"), "data": pa.array(data, pa.binary())})


ANSWER = "block long, kind int, part long, data binary"


# --- learning --------------------------------------------------------------------------------------------------------

def _count_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbols = np.zeros(257)
    for batch in batches:
        words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        symbols[:256] += np.bincount(np.frombuffer(b"".join(words), np.uint8), np.repeat(n, [len(w) for w in words]), minlength=256)
        symbols[END] += n.sum()
    yield pa.record_batch([pa.array(np.arange(257)), pa.array(symbols.astype(np.int64))], names=["symbol", "n"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
    """(keys, words, counts) of a sorted partition; words that share their first TOGETHER bytes are never parted."""
    keys, words, counts = [], [], []

    def cut(at: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        out = np.array(keys[:at], np.int64), words[:at], np.array(counts[:at], np.int64)
        del keys[:at], words[:at], counts[:at]
        return out

    for batch in batches:
        for held, c in ((keys, "key"), (words, "word"), (counts, "n")):
            held += batch.column(c).to_pylist()
        if len(words) >= CHUNK_WORDS:
            at = len(words) - 1
            while at and words[at - 1][:TOGETHER] == words[-1][:TOGETHER]:
                at -= 1
            if at:
                yield cut(at)
    if words:
        yield cut(len(words))


def _count_letters(coder) -> Callable:  # noqa: ANN001  a broadcast
    """What followed each letter context in a partition's words, as packed slices of the table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, SLOTS), np.float32)
        for n, bits in ((counts[at], Bits(coder.value, words[at])) for _, words, counts in _chunks(batches) for at in [slice(i, i + SLICE_WORDS) for i in range(0, len(words), SLICE_WORDS)]):
            weight, begin = n[bits.owner], 0
            for slots, size in zip(bits.slots, TABLE_BITS):
                for b in (0, 1):
                    mine = bits.bit == b
                    table[b, begin : begin + (1 << size)] += np.bincount(slots[mine] - begin, weight[mine], minlength=1 << size)
                begin += 1 << size
        for k, part in enumerate(np.array_split(table, SLICES, axis=1)):
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([zlib.compress(part.astype(np.float32).tobytes(), 1)], pa.binary())], names=["slice", "data"])

    return run


def _sum_slices(key: tuple, parts: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(d), np.float32).astype(np.float64) for d in parts.column("data").to_pylist())
    return pa.table({"slice": parts.column("slice").slice(0, 1), "data": pa.array([zlib.compress(total.astype(np.float32).tobytes(), 1)], pa.binary())})


def _learn(model) -> Callable:  # noqa: ANN001  a broadcast mixer
    """Online learning of the weights over a partition's training words, in the order of their hashes, each as often as
    it occurs; and what the refinement saw."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, whole, weights, seen = model.value, 0.0, 0.0, np.zeros((2, 256 * LEVELS))
        for keys, words, counts in _chunks(batches):
            order = np.argsort(keys)
            order = order[counts[order] > 0]
            if not len(order):
                continue
            counts = counts[order]
            own, steps, part = Mixer(start.coder, [], start.weights.copy(), start.refined), 0, 0.0
            begun, slices = _by_slice(start.coder, [words[i] for i in order], counts)
            for some, bits in slices:
                inputs, gates = bits.inputs(start.table, begun, counts[some], True)
                weight = counts[some][bits.owner].astype(np.float32)
                for i in range(0, len(bits.bit), STEP):
                    at = slice(i, i + STEP)
                    x, gate, y, w = [v[at] for v in inputs], gates[at], bits.bit[at], weight[at]
                    z = own.mixed(x, gate)
                    place = bits.node[at] * np.int64(LEVELS) + own.level(z)
                    for b in (0, 1):
                        seen[b] += np.bincount(place, w * (y == b), minlength=256 * LEVELS)
                    error = (y - 1 / (1 + np.exp(-z))) * w
                    held = np.maximum(np.bincount(gate, w, minlength=GATES), w.sum() / GATES)
                    rate = RATE / (1 + steps / 200)
                    for k, v in enumerate([*x, np.ones_like(z)]):
                        own.weights[k] += (rate * np.bincount(gate, error * v, minlength=GATES) / held).astype(np.float32)
                    steps += 1
                part += float(weight.sum())
            whole += part
            weights = weights + part * own.weights.astype(np.float64)
        if whole:
            yield _learned(whole, weights, seen)

    return run


def _learned(n: float, weights: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([n]), pa.array([weights.tobytes()], pa.binary()), pa.array([zlib.compress(seen.tobytes(), 1)], pa.binary())], names=["n", "weights", "seen"])


def _read_learned(rows: Iterator[tuple[float, bytes, bytes]]) -> tuple[float, np.ndarray, np.ndarray]:
    n, weights, seen = 0.0, np.zeros((PREDICTORS + 1, GATES)), np.zeros((2, 256 * LEVELS))
    for m, w, s in rows:
        n, weights, seen = n + m, weights + np.frombuffer(w).reshape(weights.shape), seen + np.frombuffer(zlib.decompress(s)).reshape(seen.shape)
    return n, weights, seen


def _merge_learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, weights, seen = _read_learned(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("n", "weights", "seen"))))
    if n:
        yield _learned(n, weights, seen)


def _spell(model) -> Callable:  # noqa: ANN001  a broadcast mixer
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, words, counts in _chunks(batches):
            bits = model.value.spelled(words, counts)
            yield pa.record_batch([pa.array(keys), pa.array(counts), pa.array(bits.astype(np.float32))], names=["key", "n", "bits"])

    return run


def train_letters(words: DataFrame) -> tuple[Mixer, DataFrame]:
    """The letter model, and (key, n, bits) of all words: n occurrences in training texts, bits that spelling takes.

    ``words``: (key, word, n), a stored table of distinct words.
    """
    spark = words.sparkSession
    symbols = np.zeros(257, np.int64)
    counted = words.select("word", "n").mapInArrow(_count_symbols, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # 257 rows
        symbols[r["symbol"]] = r["n"]
    coder = Coder.fit(symbols)
    sent = spark.sparkContext.broadcast(coder)
    # The tables have a fixed number of slots; what partitions counted is summed in two steps.
    parts = words.count() // PARTITION_WORDS + 1
    tasks = max(spark.sparkContext.defaultParallelism, parts)
    slices = words.select("key", "word", "n").coalesce(parts).mapInArrow(_count_letters(sent), "slice int, data binary").withColumn("some", F.spark_partition_id() % (int(tasks**0.5) + 1))
    slices = slices.groupBy("slice", "some").applyInArrow(_sum_slices, "slice int, data binary").groupBy("slice").applyInArrow(_sum_slices, "slice int, data binary")
    empty = [zlib.compress(x.tobytes(), 1) for x in np.array_split(np.zeros((2, SLOTS), np.float32), SLICES, axis=1)]
    found = {r["slice"]: bytes(r["data"]) for r in slices.collect()}  # SLICES rows, together of SLOTS slots
    model = Mixer.fresh(coder, [found.get(k, empty[k]) for k in range(SLICES)])
    sorted_ = stored(words.repartition(tasks, F.substring("word", 1, TOGETHER)).sortWithinPartitions("word"), "lm-sorted")
    first = spark.sparkContext.broadcast(model)
    learned = sorted_.mapInArrow(_learn(first), "n double, weights binary, seen binary")
    learned = learned.repartition(int(tasks**0.5) + 1).mapInArrow(_merge_learned, "n double, weights binary, seen binary").collect()
    first.unpersist()
    n, weights, seen = _read_learned((r["n"], r["weights"], r["seen"]) for r in learned)
    if n:
        # A level that was seldom seen stays near the mixed prediction itself.
        seen = seen.reshape(2, 256, LEVELS)
        p = 1 / (1 + np.exp(-model.refined.astype(np.float64)))
        refined = np.clip(np.log((seen[1] + 20 * p) / (seen[0] + 20 * (1 - p))), -LIMIT, LIMIT)
        model = Mixer(coder, model.slices, (weights / n).astype(np.float32), refined.astype(np.float32))
    last = spark.sparkContext.broadcast(model)
    spelled = stored(sorted_.mapInArrow(_spell(last), "key long, n long, bits float"), "lm-spelled")
    release(sorted_)
    return model, spelled


# --- scores ----------------------------------------------------------------------------------------------------------

_TEXT = pa.schema([("id", pa.int64()), ("trains", pa.bool_()), ("tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("bits", pa.float64()), ("cells", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])
TEXT = "id long, trains boolean, tokens long, known long, logs double, bits double, cells array<int>, times array<long>"


def _score(weight: float) -> Callable:
    """For each text of a block: words, known words, the base's sum, bits of the words that are spelled, and how often
    each cell of the word predictions was met (2 x cell + hit)."""
    def run(key: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for b in blocks.to_pylist():
            sizes = np.array(b["sizes"], np.int64)
            vocabulary, places = np.frombuffer(b["vocabulary"], np.uint64), _unpacked(b["places"], 4).astype(np.int64)
            got = sorted(zip(*(answers.column(c).to_pylist() for c in ("kind", "part", "data"))), key=lambda r: r[:2])
            n, bits = [], []
            for d in (d for kind, _, d in got if kind == 0):
                m = int(np.frombuffer(d[:4], "<u4")[0])
                n.append(_unpacked(d[4 : 4 + m]))
                bits.append(_unpacked(d[4 + m :], 4).astype(np.uint32).view(np.float32))
            order = np.argsort(vocabulary)
            counts, spelled = np.zeros(len(order), np.int64), np.zeros(len(order))
            if len(order):
                counts[order], spelled[order] = np.concatenate(n), np.concatenate(bits)
            found = np.zeros(len(places), np.uint8)
            if len(places):
                found[np.argsort(_contexts(vocabulary, places, sizes)[0], kind="stable")] = np.concatenate([np.frombuffer(zlib.decompress(d), np.uint8) for kind, _, d in got if kind == 1])
            owner = np.repeat(np.arange(len(sizes)), sizes)
            sums = lambda x: np.bincount(owner, x, minlength=len(sizes))
            cells = _cells(found, np.cumsum(sizes) - sizes, sizes)
            told = found > 0
            pairs, times = np.unique(owner[told] * (2 * CELLS) + cells[told], return_counts=True)
            ends = np.searchsorted(pairs, np.arange(len(sizes) + 1) * (2 * CELLS))
            offsets = pa.array(ends.astype(np.int32))
            out.append(pa.record_batch([
                pa.array(b["ids"], pa.int64()), pa.array(b["trains"], pa.bool_()), pa.array(sizes), pa.array(sums(counts[places] > 0).astype(np.int64)),
                pa.array(sums(np.log10((counts + 0.5) / weight)[places])), pa.array(sums(np.where(cells & 1 & told, 0, spelled[places]))),
                pa.ListArray.from_arrays(offsets, pa.array((pairs % (2 * CELLS)).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64))),
            ], schema=_TEXT))
        return pa.Table.from_batches(out, _TEXT)

    return run


def _cells(found: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """2 x (cell and run of predictions that held just before) + hit, for every token."""
    place = np.arange(len(found))
    # The last place up to each token whose word was not predicted; a text starts with a run of none.
    broken = np.where((found & 1) == 0, place, -1)
    last = np.maximum.accumulate(broken) if len(found) else broken
    before = np.concatenate([[-1], last[:-1]]) if len(found) else last
    run = place - 1 - np.maximum(before, np.repeat(begin, sizes) - 1)
    return ((found >> 1).astype(np.int64) * (len(RUNS) + 1) + np.searchsorted(RUNS, run, "right")) * 2 + (found & 1)


def _bits_for(n: float, size: int) -> int:
    """Leading bits that part ``n`` rows in ranges of about ``size``."""
    return max(1, int(np.ceil(np.log2(max(n, 1) / size))))


def score_texts(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``score`` is the mixer's log10 probability of the whole text, as its words with single blanks between them and an
    end; bits per byte are its negative times log2(10) over the bytes. ``base_score`` is that of the words and the end
    under unigram counts with half a count added. Both learn from all rows where ``trains`` holds; to predict a word from
    the two before it, a training text's own occurrence is left out, so that a text does not predict itself.

    Edge cases: null text counts as empty and has its end only; ids may be null or repeated, each row is scored; texts of
    any length are worked on in pieces; without training rows all counts are zero and the mixer knows nothing; an empty
    table gives an empty one. Words are told apart by 64-bit hashes; contexts of words by 32 bits inside hash ranges whose
    number grows with the corpus, and their followers by 24 bits.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.coalesce(trains, F.lit(False)).alias("trains"))
    blocks = stored(rows.mapInArrow(_blocks, BLOCK), "lm-blocks")
    words = blocks.select("vocabulary", "counts", "spelled").mapInArrow(_words, "key long, word binary, n long")
    words = stored(words.groupBy("key").agg(F.any_value("word").alias("word"), F.sum("n").alias("n")), "lm-words")
    total, distinct, every = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0), F.count(F.lit(1))).first()
    tokens, ends = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum(F.size(F.filter("trains", lambda t: t))), F.lit(0))).first()
    total, distinct = int(total) + ends, int(distinct) + (1 if ends else 0)
    weight = total + 0.5 * (distinct + 1)
    _, spelled = train_letters(words)
    release(words)

    word_bits, context_bits = _bits_for(every, RANGE_WORDS), _bits_for(tokens, RANGE_TOKENS)
    asked = blocks.select("block", "vocabulary").mapInArrow(_ask_words(word_bits), ASK)
    priced = spelled.withColumn("part", F.shiftrightunsigned("key", 64 - word_bits))
    answers = stored(asked.groupBy("part").cogroup(priced.groupBy("part")).applyInArrow(_answer_words, ANSWER), "lm-answers")
    asked = blocks.select("block", "vocabulary", "places", "sizes", "trains").mapInArrow(_ask_contexts(context_bits), ASK)
    told = stored(asked.groupBy("part").applyInArrow(_answer_contexts, ANSWER), "lm-answers")
    whole = blocks.select("block", "ids", "trains", "sizes", "vocabulary", "places")
    texts = stored(whole.groupBy("block").cogroup(answers.union(told).groupBy("block")).applyInArrow(_score(weight), TEXT), "lm-texts")
    release(blocks, spelled, answers, told)

    # Word predictions: how often each cell held in training texts gives what it costs everywhere.
    met = texts.filter("trains").select(F.explode(F.arrays_zip("cells", "times")).alias("m")).groupBy("m.cells").agg(F.sum("m.times").alias("n")).collect()  # at most 2 x CELLS rows
    seen = np.zeros((CELLS, 2))
    for r in met:
        seen[r["cells"] >> 1, r["cells"] & 1] = r["n"]
    cost = -np.log2((seen + 0.4) / (seen.sum(1, keepdims=True) + 0.8)).ravel()
    costs = F.array(*(F.lit(float(c)) for c in cost))
    told = F.aggregate(F.zip_with("cells", "times", lambda c, t: F.get(costs, c) * t), F.lit(0.0), lambda a, b: a + b)
    end = (ends + 0.5) / (total + 1.0)
    bits = F.col("bits") + told + F.col("tokens") * float(-np.log2(1 - end)) + float(-np.log2(end))
    base = F.col("logs") + float(np.log10((ends + 0.5) / weight))
    return texts.select(
        F.col("id").alias(id_col), (F.col("tokens") + 1).alias("n_tokens"), (F.col("known") + (1 if ends else 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (bits * float(-np.log10(2))).alias("score"),
    )
