"""Quality rules: plain counts of a text, and its perplexity under a modified Kneser-Ney model with bands by language.

The model is one of characters: grams of ORDER code points of the text with A-Z lower-cased and white space collapsed.
Spark counts the grams; tables of every order, each grouped from the one above it, give discounts and probabilities; the
result lies in arrays sorted by the grams' hashes. Two folds, by the text's checksum, score each other, so neither a text
nor its exact copies predict it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import release, stored, text_pieces

ORDER = 5
#: Code points that are counted or scored at once, distinct grams a task holds before it hands them on.
GROUP, FLUSH = 1 << 21, 1 << 20
#: Alphabet up to which a gram and its fold fit 63 bits; larger groups of texts are halved.
ALPHABET = 5404
#: Grams up to which the arrays go to every task (12 bytes each); beyond, blocks of texts ask for what they need in a join.
BROADCAST = 1 << 23
#: Grams of one row of the stored arrays, about.
ROW_GRAMS = 1 << 17
#: Rules of the counts: least words; most words, in hundredths, inside repeated windows of REPEAT words.
LEAST_WORDS, MOST_REPEATED, REPEAT = 20, 30, 8
#: Bands: so many times the distance of the tenth to the ninetieth part of all texts lie beyond either, STEP bits a bucket.
LOW, HIGH, SPREAD, STEP = 0.10, 0.90, 1.0, 1 / 1024

_MEASURES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, grams long, bits double, digest long"


# --- text to grams ---------------------------------------------------------------------------------------------------

def _bytes(column: pa.Array) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column.cast(pa.binary())]


def _normal(text: bytes, tail: str = "") -> np.ndarray:
    """Code points of a text: A-Z lower-cased, each run of ASCII white space one space; none at the beginning."""
    lowered = b" ".join(text.lower().split()).decode("utf-8", "replace")
    lowered = f"{tail} {lowered}" if tail else lowered
    return np.frombuffer(lowered.encode("utf-32-le"), np.uint32)


def _units(text: bytes) -> Iterator[np.ndarray]:
    """A text as pieces of bounded size; each begins with the last ORDER - 1 code points before it, so no gram is lost."""
    tail = ""
    for piece in text_pieces(text):
        if not piece.split():
            continue
        points = _normal(piece, tail)
        yield points
        tail = points[-(ORDER - 1) :].tobytes().decode("utf-32-le")


def _groups(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, begin of each unit, its text's place) for so many units at a time as GROUP allows."""
    units, owners, size = [], [], 0
    for i, text in enumerate(texts):
        for points in _units(text):
            if units and size + len(points) > GROUP:
                yield np.concatenate(units), np.cumsum([0, *map(len, units)]), np.array(owners)
                units, owners, size = [], [], 0
            units.append(points)
            owners.append(i)
            size += len(points)
    if units:
        yield np.concatenate(units), np.cumsum([0, *map(len, units)]), np.array(owners)


def _windows(begins: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places, owners) of all grams that lie in one unit."""
    lengths = np.maximum(np.diff(begins) - (ORDER - 1), 0)
    skipped = np.cumsum(lengths) - lengths
    places = np.arange(lengths.sum()) + np.repeat(begins[:-1] - skipped, lengths)
    return places, np.repeat(owners, lengths)


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for points in columns:
        h = (h ^ points.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _counted(points: np.ndarray, places: np.ndarray, folds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(grams, one row of code points each, fold, count) of the windows at ``places``."""
    if not len(places):
        return
    alphabet, ids = np.unique(points[places[0] : places[-1] + ORDER], return_inverse=True)
    n = len(alphabet)
    if n > ALPHABET:
        half = len(places) // 2
        yield from _counted(points, places[:half], folds[:half])
        yield from _counted(points, places[half:], folds[half:])
        return
    at = places - places[0]
    key = folds.astype(np.int64)
    for j in range(ORDER):
        key = key * n + ids[at + j]
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    key, counts = key[first], np.diff(np.append(first, len(key)))
    grams = np.empty((len(key), ORDER), np.uint32)
    for j in reversed(range(ORDER)):
        grams[:, j] = alphabet[key % n]
        key //= n
    yield grams, key, counts


def _strings(grams: np.ndarray) -> pa.Array:
    flat = grams.reshape(-1)
    sizes = 1 + (flat > 0x7F).astype(np.int32) + (flat > 0x7FF) + (flat > 0xFFFF)
    ends = np.concatenate([[0], np.cumsum(sizes.reshape(grams.shape).sum(axis=1))]).astype(np.int32)
    data = flat.tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(grams), pa.py_buffer(ends), pa.py_buffer(data))


def _fold(text: bytes) -> int:
    return zlib.crc32(text) & 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts (h, gram, c0, c1) of a task's texts; distinct grams are merged until FLUSH of them have come."""
    held: dict[str, list] = {"g": [], "f": [], "n": []}
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        grams, folds, counts = (np.concatenate(held[k]) for k in "gfn")
        h = _hash([grams[:, j] for j in range(ORDER)])
        order = np.argsort(h, kind="stable")
        h, grams, folds, counts = h[order], grams[order], folds[order], counts[order]
        new = np.append(True, (h[1:] != h[:-1]) | (grams[1:] != grams[:-1]).any(axis=1))
        first = np.flatnonzero(new)
        sums = [np.add.reduceat(np.where(folds == f, counts, 0), first) for f in (0, 1)]
        return h[first], grams[first], sums

    def merge() -> None:
        h, grams, sums = flush()
        held.update(g=[grams, grams], f=[np.zeros(len(h), np.int64), np.ones(len(h), np.int64)], n=[sums[0], sums[1]])

    def rows() -> Iterator[pa.RecordBatch]:
        h, grams, (c0, c1) = flush()
        for a in range(0, len(h), 1 << 16):
            b = a + (1 << 16)
            yield pa.record_batch([pa.array(h[a:b]), _strings(grams[a:b]), pa.array(c0[a:b]), pa.array(c1[a:b])], names=["h", "g", "c0", "c1"])

    for batch in batches:
        texts = _bytes(batch.column("text"))
        folds = np.array([_fold(t) for t in texts], np.int64)
        for points, begins, owners in _groups(texts):
            places, of = _windows(begins, owners)
            for grams, f, n in _counted(points, places, folds[of]):
                for k, v in zip("gfn", (grams, f, n)):
                    held[k].append(v)
                size += len(n)
            if size > 2 * FLUSH:
                merge()
                size = sum(map(len, held["f"]))
                if size > 2 * FLUSH:
                    yield from rows()
                    held, size = {"g": [], "f": [], "n": []}, 0
    if held["g"]:
        yield from rows()


# --- the model ---------------------------------------------------------------------------------------------------------

def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and above from how many grams were seen 1, 2, 3 and 4 times; common
    ones where the estimate is undefined or not between 0 and the count, so that every probability is above 0."""
    found = [k - (k + 1) * n[0] / (n[0] + 2 * n[1]) * n[k] / n[k - 1] for k in (1, 2, 3)] if min(n) > 0 else [0.0]
    return found if all(0 < x <= k for k, x in enumerate(found, 1)) else [0.5, 1.0, 1.5]


def _probability(c: str, stats: str, lower: Column, d: list[float]) -> Column:
    """Interpolated: the discounted share of the gram after its context, the rest by what is one code point shorter."""
    total, n1, n2, n3 = (F.col(f"{stats}.{k}") for k in ("total", "n1", "n2", "n3"))
    cut = F.when(F.col(c) == 0, 0.0).when(F.col(c) == 1, d[0]).when(F.col(c) == 2, d[1]).otherwise(d[2])
    return F.when(total > 0, (F.col(c) - cut + (d[0] * n1 + d[1] * n2 + d[2] * n3) * lower) / total).otherwise(lower)


def _stats(c: str) -> Column:
    return F.struct(F.sum(c).alias("total"), F.count_if(F.col(c) == 1).alias("n1"), F.count_if(F.col(c) == 2).alias("n2"), F.count_if(F.col(c) > 2).alias("n3"))


def _levels(docs: DataFrame) -> list[DataFrame]:
    """Counts (g, c0, c1) of the grams of every length, longest first: occurrences, below that distinct extensions to the
    left. Each is stored."""
    counts = docs.select("text").mapInArrow(_count, "h long, g string, c0 long, c1 long")
    levels = [stored(counts.groupBy("h", "g").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), "grams")]
    for k in range(ORDER - 1, 0, -1):
        shorter = levels[-1].groupBy(F.substring("g", 2, k).alias("g")).agg(F.count_if(F.col("c0") > 0).alias("c0"), F.count_if(F.col("c1") > 0).alias("c1"))
        levels.append(stored(shorter, "grams"))
    return levels


def train_model(docs: DataFrame) -> DataFrame:
    """The model in rows (part, keys, l0, l1): grams' hashes of one range in order, and the logarithm of their probability
    under the counts of either fold. Every gram of ``docs`` is there, so scoring them backs off nowhere."""
    levels = _levels(docs)
    below = None
    for k, level in enumerate(reversed(levels), 1):
        seen = level.agg(*(F.count_if(F.col(c) == i).alias(f"{c}_{i}") for c in ("c0", "c1") for i in (1, 2, 3, 4)), F.count(F.lit(1)).alias("n")).first()
        d = [discounts([seen[f"{c}_{i}"] for i in (1, 2, 3, 4)]) for c in ("c0", "c1")]
        if k == 1:
            total = level.agg(_stats("c0").alias("s0"), _stats("c1").alias("s1"))
            rows, low = level.crossJoin(F.broadcast(total)), [F.lit(1.0 / (seen["n"] + 1))] * 2  # total is one row
        else:
            context = level.groupBy(F.substring("g", 1, k - 1).alias("context")).agg(_stats("c0").alias("s0"), _stats("c1").alias("s1"))
            rows = level.withColumns({"context": F.substring("g", 1, k - 1), "shorter": F.substring("g", 2, k - 1)}).join(context, "context")
            rows, low = rows.join(below.select(F.col("g").alias("shorter"), "p0", "p1"), "shorter").withColumnsRenamed({"p0": "low0", "p1": "low1"}), [F.col("low0"), F.col("low1")]
        own = ["g", "h"] if k == ORDER else ["g"]
        below = rows.select(*own, *(_probability(f"c{i}", f"s{i}", low[i], d[i]).alias(f"p{i}") for i in (0, 1)))
        if 1 < k < ORDER:
            below = stored(below, "probabilities")
            levels.append(below)
    bits = max(1, int(seen["n"] // ROW_GRAMS).bit_length())
    rows = below.select(F.shiftright("h", 64 - bits).alias("part"), F.struct("h", F.log("p0").cast("float").alias("l0"), F.log("p1").cast("float").alias("l1")).alias("e"))
    packed = rows.groupBy("part").agg(F.sort_array(F.collect_list("e")).alias("e")).select("part", *(F.col(f"e.{c}").alias(a) for c, a in (("h", "keys"), ("l0", "l0"), ("l1", "l1"))))
    model = stored(packed, "model")
    release(*levels)
    return model


class SortedArrays:
    """Look-up in hashes in order: the leading bits give the first place, from there on step by step."""

    def __init__(self, keys: np.ndarray, values: list[np.ndarray]) -> None:
        self.keys, self.values = keys, values
        self.bits = min(24, max(4, int(len(keys)).bit_length()))
        self.first = np.searchsorted(keys, (np.arange(1 << self.bits, dtype=np.int64) - (1 << (self.bits - 1))) << (64 - self.bits)).astype(np.int32)

    def places(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            raise ValueError("texts changed between counting and scoring")
        at = self.first[(h >> (64 - self.bits)) + (1 << (self.bits - 1))]
        last = len(self.keys) - 1
        open_ = np.flatnonzero(self.keys[np.minimum(at, last)] != h)
        while len(open_):
            at[open_] += 1
            if at[open_].max() > last:
                raise ValueError("texts changed between counting and scoring")
            open_ = open_[self.keys[at[open_]] != h[open_]]
        return at

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of grams, sum of their logarithms) of each text; a text is judged by the other fold's counts."""
        n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        folds = np.array([_fold(t) for t in texts], np.int64)
        for points, begins, owners in _groups(texts):
            places, of = _windows(begins, owners)
            if not len(places):
                continue
            at = self.places(_hash([points[places + j] for j in range(ORDER)]))
            logs = np.where(folds[of] == 0, self.values[1][at], self.values[0][at]).astype(np.float64)
            n += np.bincount(of, minlength=len(texts))
            total += np.bincount(of, logs, minlength=len(texts))
        return n, total


# --- counts of a text ------------------------------------------------------------------------------------------------

def repeated_words(words: list[bytes], size: int = REPEAT) -> int:
    """Words inside windows of ``size`` words that are found twice or more, the first included. size: a power of two."""
    known: dict[bytes, int] = {}
    ranks = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    span = 1
    while span < size:  # equal ranks mean equal windows of span words
        if len(ranks) <= span or len(known) == len(words):
            return 0
        pairs = ranks[:-span] * (ranks.max() + 1) + ranks[span:]
        ranks = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        span *= 2
    again = np.flatnonzero(np.bincount(ranks)[ranks] > 1)
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, again, 1)
    np.add.at(marks, again + size, -1)
    return int((np.cumsum(marks) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def _counts(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    chars = sum(map(len, words)) - sum(np.count_nonzero(np.frombuffer(piece, np.uint8) >> 6 == 2) for piece in text_pieces(text))
    symbols = sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    return len(words), int(chars), symbols, duplicate_lines(text), repeated_words(words)


def _measured(ids: list, langs: list, texts: list[bytes], arrays: SortedArrays) -> pa.RecordBatch:
    grams, logs = arrays.score(texts)
    columns = [*zip(*map(_counts, texts))] if texts else [()] * 5
    bits = [-t / n / np.log(2) if n else None for n, t in zip(grams.tolist(), logs.tolist())]
    digests = [int.from_bytes(zlib.crc32(t).to_bytes(4, "big") + zlib.adler32(t).to_bytes(4, "big"), "big", signed=True) for t in texts]
    names = [x.split()[0] for x in _MEASURES.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    values = [ids, langs, *map(list, columns), grams.tolist(), bits, digests]
    return pa.record_batch([pa.array(v, kinds[x.split()[1]]) for v, x in zip(values, _MEASURES.split(", "))], names=names)


# --- scoring -----------------------------------------------------------------------------------------------------------

def _score_everywhere(docs: DataFrame, model: DataFrame) -> tuple[DataFrame]:
    """The arrays, of a size that was counted before, go to every task."""
    parts = model.orderBy("part").toArrow()
    flat = lambda name, kind: np.concatenate([c.values.to_numpy() for c in parts.column(name).chunks] or [np.empty(0)]).astype(kind)
    sent = docs.sparkSession.sparkContext.broadcast((flat("keys", np.int64), flat("l0", np.float32), flat("l1", np.float32)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, *values = sent.value
        arrays = SortedArrays(keys, values)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                yield _measured(part.column("doc_id").to_pylist(), part.column("lang").to_pylist(), _bytes(part.column("text")), arrays)

    return (docs.mapInArrow(score, _MEASURES),)


_BLOCK = "block string, h long, l0 float, l1 float, ids array<long>, langs array<string>, texts array<binary>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts: a row with the texts (h null), and a row for each gram that they hold."""
    from pyspark import TaskContext

    names, n = [x.split()[0] for x in _BLOCK.split(", ")], 0
    kinds = [pa.string(), pa.int64(), pa.float32(), pa.float32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.binary())]
    ids, langs, texts = [], [], []

    def block() -> Iterator[pa.RecordBatch]:
        name = f"{TaskContext.get().partitionId()}-{n}"
        yield pa.record_batch([pa.array([v], k) for v, k in zip((name, None, None, None, ids, langs, texts), kinds)], names=names)
        found = []
        for points, begins, owners in _groups(texts):
            places, _ = _windows(begins, owners)
            if len(places):
                found.append(np.unique(_hash([points[places + j] for j in range(ORDER)])))
        h = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        for a in range(0, len(h), 1 << 14):
            part = h[a : a + (1 << 14)]
            yield pa.record_batch([pa.array([name] * len(part)), pa.array(part), *(pa.nulls(len(part), k) for k in kinds[2:])], names=names)

    for batch in batches:
        for i, lang, text in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), _bytes(batch.column("text"))):
            ids.append(i), langs.append(lang), texts.append(text)
            if sum(map(len, texts[-64:])) > 4 * GROUP or len(texts) % 64 == 0 and sum(map(len, texts)) > 4 * GROUP:
                yield from block()
                ids, langs, texts, n = [], [], [], n + 1
    if ids:
        yield from block()


def _score_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of block, its texts before its grams."""
    name, held, answers = None, None, []

    def scored() -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*answers)] if answers else [np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, np.float32)]
        yield _measured(*held, SortedArrays(columns[0], columns[1:]))

    for batch in batches:
        blocks = batch.column("block").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if blocks[a] != name:
                if held:
                    yield from scored()
                name, held, answers = blocks[a], None, []
            part = batch.slice(a, b - a)
            if not part.column("h")[0].is_valid:
                held = tuple(part.column(c)[0].as_py() for c in ("ids", "langs", "texts"))
                part = part.slice(1)
            if part.num_rows:
                answers.append(tuple(part.column(c).to_numpy() for c in ("h", "l0", "l1")))
    if held:
        yield from scored()


def _score_in_blocks(docs: DataFrame, model: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Beyond BROADCAST grams: blocks of texts get the values of just the grams that they hold, by a join on the hash."""
    blocks = stored(docs.mapInArrow(_blocks, _BLOCK), "blocks")
    entries = model.select(F.explode(F.arrays_zip("keys", "l0", "l1")).alias("e")).select(F.col("e.keys").alias("h"), F.col("e.l0").alias("l0"), F.col("e.l1").alias("l1"))
    names = [x.split()[0] for x in _BLOCK.split(", ")]
    answered = blocks.filter("h is not null").drop("l0", "l1").join(entries, "h").select(*names)
    rows = blocks.filter("h is null").select(*names).union(answered)
    return rows.repartition("block").sortWithinPartitions("block", F.asc_nulls_first("h")).mapInArrow(_score_block, _MEASURES), blocks


def _bands(measured: DataFrame) -> DataFrame:
    """(lang, lower, upper) in bits a character, from all texts that the counts let pass, each distinct one once.

    A histogram in steps of STEP gives the quantiles exactly to a step, whatever the order of rows.
    """
    once = measured.filter("not base_failed and bits is not null").groupBy("lang", "digest", "n_words").agg(F.min("bits").alias("bits"))
    steps = once.groupBy("lang", F.floor(F.col("bits") / STEP).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("lang").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # rows are steps: bounded by the largest code length
    placed = steps.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy("lang"))})
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("step"))) * STEP
    found = placed.groupBy("lang").agg(at(LOW).alias("low"), at(HIGH).alias("high"))
    width = SPREAD * F.greatest(F.col("high") - F.col("low"), F.lit(16 * STEP))
    return found.select("lang", (F.col("low") - width).alias("lower"), (F.col("high") + STEP + width).alias("upper"))


def judge_quality(docs: DataFrame) -> DataFrame:
    """Counts, perplexity and verdict of every row of ``docs`` (doc_id, text, lang; other columns are not read).

    A row is rejected if its counts fail (``base_failed``) or if its bits a character lie outside the band of its language;
    rows of no language share a band of their own. Null texts count as empty; texts without a gram have no perplexity and
    are rejected by their counts alone. Repeated rows each give a row and weigh once in the bands. An empty table gives
    none. Returns doc_id, lang, the counts, base_failed, perplexity (a character), lower and upper (its bounds), kept.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    model = train_model(rows)
    grams = model.agg(F.sum(F.size("keys"))).first()[0] or 0
    measured, *made = (_score_everywhere if grams <= BROADCAST else _score_in_blocks)(rows, model)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    measured = stored(measured.withColumn("base_failed", failed), "measured")
    release(model, *made)
    bands = stored(_bands(measured), "bands").withColumnRenamed("lang", "of")
    judged = measured.join(bands, F.col("lang").eqNullSafe(F.col("of")), "left")
    inside = F.coalesce(F.col("bits").between(F.col("lower"), F.col("upper")), F.lit(True))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", "lang", *counts, "base_failed", *(F.pow(F.lit(2.0), c).alias(a) for c, a in (("bits", "perplexity"), ("lower", "lower"), ("upper", "upper"))), (~F.col("base_failed") & inside).alias("kept"))
