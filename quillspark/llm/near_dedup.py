"""Near-duplicate detection over word shingles by circulant MinHash, banding and exact Jaccard verification.

Two permutations make a whole signature: the first scatters shingles over a fixed universe, the second, shifted
circularly by k places, gives coordinate k.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import fresh, stored

SHINGLE_WORDS = 5
#: Texts are linked when 100 x intersection >= PERCENT x union.
PERCENT = 75
#: A pair at the threshold shares a band of four coordinates with probability 0.316, one of 25 bands with 0.99992.
BANDS, ROWS = 25, 4
UNIVERSE_BITS = 20
#: Buckets up to this size are compared pair by pair where their members are still in different components; larger
#: ones by the rare shingles that two similar texts must share, and share early enough in the order of rarity.
SMALL_BUCKET = 4
#: Rounds of comparing buckets with a leader at most. More of them leave less to compare; they change no result.
ROUNDS = 3
#: Slots of the count sketch that orders shingles by rarity. Its size changes the speed only.
SKETCH_BITS = 20

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    letters = rng.integers(1, 1 << 63, 256, np.uint64)
    powers = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    pi = rng.permutation(1 << UNIVERSE_BITS).astype(np.uint32)
    return letters, powers, np.concatenate([pi, pi[: BANDS * ROWS]])


def run_hashes(flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of bytes that don't overlap, none empty, in order."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    letters, powers, _ = _tables()
    sizes = end - begin
    first = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(first, sizes)
    where = place + np.repeat(begin, sizes)
    return _mix(np.add.reduceat(letters[flat[where]] * powers[place & 4095] + place.astype(np.uint64), first))


def words_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Some texts with A-Z lower-cased as one array of bytes; begin, size, 64-bit hash and text number of each word."""
    flat = np.frombuffer(b"\n".join(t.lower() if t else b"" for t in texts) + b"\n", np.uint8)
    blank = (flat == 32) | ((flat >= 9) & (flat <= 13))
    before = np.concatenate([[True], blank[:-1]])
    starts = np.flatnonzero(~blank & before)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return flat, none, none, np.zeros(0, np.uint64), none
    stops = np.flatnonzero(blank & ~before)
    ends = np.cumsum([(len(t) if t else 0) + 1 for t in texts])
    return flat, starts, stops - starts, run_hashes(flat, starts, stops), np.searchsorted(ends, starts, "right")


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, A-Z lower-cased, one after another, and the text number of each."""
    return words_of(texts)[3:]


def shingle_sets(texts: list[bytes | None], width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of ``width`` words, over words with A-Z lower-cased.

    A text of fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    _, powers, _ = _tables()
    hashes, owner = word_hashes(texts)
    n = len(hashes)
    joint = np.zeros(n, np.uint64)
    for j in range(min(width, n)):
        joint[: n - j] += hashes[j:] * powers[j + 1]
    joint = _mix(joint)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(joint[a : b - width + 1]))
        elif b > a:
            out.append(_mix(np.array([(hashes[a:b] * powers[1 : b - a + 1]).sum() + _U(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Circulant MinHash of non-empty sets: coordinate k is the least value of the second permutation shifted by k."""
    _, _, pi = _tables()
    k, n = BANDS * ROWS, 1 << UNIVERSE_BITS
    rows = np.lib.stride_tricks.sliding_window_view(pi, k)
    out = np.empty((len(sets), k), np.uint32)
    for i, s in enumerate(sets):
        places = ((s >> _U(64 - UNIVERSE_BITS)) * _U(0x9E3B5) + _U(0x5BD1E)) & _U(n - 1)  # an odd factor permutes the universe
        best = rows[places[:2048]].min(0)
        for j in range(2048, len(places), 2048):
            np.minimum(best, rows[places[j : j + 2048]].min(0), out=best)
        out[i] = best
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, different for equal values in different bands."""
    v = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None] * _U(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        key = _mix(key + v[:, :, j] + _U(j + 1))
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            sets = shingle_sets(part.column("text").to_pylist())
            full = [s for s in sets if len(s)]
            keys = band_keys(signatures(full)) if full else np.zeros((0, BANDS), np.int64)
            digests = [_digest(s) if len(s) else None for s in sets]
            sizes = np.cumsum([0] + [BANDS * (len(s) > 0) for s in sets])
            bands = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(keys.ravel()))
            yield pa.record_batch([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), bands], names=["id", "n", "digest", "bands"])


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _verify(percent: int) -> Callable:
    """Pairs of texts whose shingle sets are similar enough; a text that isn't the one meant (repeated ids) is skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                a, b, ta, tb = (batch.slice(i, 256).column(n).to_pylist() for n in ("a", "b", "text_a", "text_b"))
                need = {d: t for d, t in [*zip(a, ta), *zip(b, tb)] if d not in kept}
                if len(kept) > 2048:
                    kept = {}
                    need = dict([*zip(a, ta), *zip(b, tb)])
                kept.update(zip(need, shingle_sets(list(need.values()))))
                linked = []
                for x, y in zip(a, b):
                    s, t = kept[x], kept[y]
                    both = len(np.intersect1d(s, t, assume_unique=True)) if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) else 0
                    linked.append(100 * both >= percent * (len(s) + len(t) - both))
                hit = [(x, y) for x, y, ok in zip(a, b, linked) if ok]
                yield pa.record_batch([pa.array([h[0] for h in hit], pa.binary()), pa.array([h[1] for h in hit], pa.binary())], names=["a", "b"])

    return run


def _links(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass. b, the leader of many pairs perhaps, is joined last, so its text isn't multiplied
    before the rows stand where they are compared."""
    one = pairs.join(texts.select(F.col("digest").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("digest").alias("b"), F.col("text").alias("text_b")), "b")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(_verify(percent), "a binary, b binary")


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            for s in shingle_sets(batch.slice(i, 256).column("text").to_pylist()):
                counts[(s & _U((1 << SKETCH_BITS) - 1)).astype(np.int64)] += 1
    slots = np.flatnonzero(counts > 1)
    yield pa.record_batch([pa.array(slots), pa.array(counts[slots])], names=["slot", "n"])


def _prefixes(slots: np.ndarray, counts: np.ndarray, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << SKETCH_BITS, np.int64)
        table[slots] = counts
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = shingle_sets(part.column("text").to_pylist())
                chosen, places = [], []
                for s in sets:
                    order = np.lexsort((s, table[(s & _U((1 << SKETCH_BITS) - 1)).astype(np.int64)]))
                    chosen.append(s[order[: len(s) - -(-percent * len(s) // 100) + 1]])
                    places.append(np.arange(len(chosen[-1])))
                lengths = [len(c) for c in chosen]
                at = np.repeat(np.arange(len(sets)), lengths)
                flat = np.concatenate(chosen).view(np.int64)
                yield pa.record_batch([*(part.column(n).take(pa.array(at)) for n in ("digest", "comp", "n")), pa.array(flat), pa.array(np.concatenate(places))], names=["digest", "comp", "n", "key", "pos"])

    return run


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of members (key, digest, comp, n, pos) with one key but different components that may be linked.

    pos: how many of the member's shingles stand before the key in the order of rarity. If the key is the first that two
    share, they share no more than what follows it in either; that and the sizes rule most pairs out.
    Only members outside the key's largest component look for partners, so a key that one big group holds costs its
    group one comparison for each other member, not the square.
    """
    sizes = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    live = members.join(sizes.select("key", F.col("top.comp").alias("main")), "key")
    left = live.filter(F.col("comp") != F.col("main")).select("key", F.col("digest").alias("a"), F.col("comp").alias("comp_a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"))
    right = live.select("key", F.col("digest").alias("b"), F.col("comp").alias("comp_b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"), (F.col("comp") == F.col("main")).alias("in_main"))
    fits = (F.col("comp_a") != F.col("comp_b")) & (F.col("in_main") | (F.col("a") < F.col("b"))) & ((100 + percent) * F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= percent * (F.col("n_a") + F.col("n_b")))
    pairs = left.join(right, "key").filter(fits)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _joined(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """New links beside those of each node to the root of its component so far."""
    return links if found is None else links.select("a", "b").union(found.select(F.col("node").alias("a"), F.col("root").alias("b")))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id`` and ``kept`` (the id is its component's least).

    Rows with equal shingle sets form one class. In each bucket of classes that share a band, all are first compared
    with one leader, the most central class of the bucket, and where they are still apart with the next one, for some
    rounds; then members of different components are compared with each other, in large buckets only where they share
    one of the rare shingles that any similar pair must share. So no candidate is lost and no group is compared pair by
    pair with itself: in a group of altered copies, what isn't linked with the centre mostly differs by so many rare
    shingles that no other member can be near either.

    Shingles are compared by 64-bit hashes of their words.

    Edge cases: null and empty texts and texts without words have no shingles and link with nothing; rows with a null
    id take part, but never name a component unless all ids in it are null; repeated ids are told apart by content;
    an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    signed = stored(rows.mapInArrow(_sign, "id long, n long, digest binary, bands array<long>"), "near-signed")
    members = signed.filter("n > 0").select("digest", "n", F.explode("bands").alias("key")).distinct()
    members = members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "key")
    # A class is the more central, the more others its buckets hold.
    members = members.join(members.groupBy("digest").agg(F.sum("m").alias("central")), "digest")
    members = stored(members, "near-members")

    # Texts of the classes that share a band with another: one row for each class.
    classes = members.select("digest").distinct()
    owners = signed.filter("n > 0").join(classes, "digest", "left_semi").groupBy("digest").agg(F.min("id").alias("id"))
    texts = rows.withColumn("key", F.coalesce("id", F.lit(-(1 << 63)))).join(owners.select("digest", F.coalesce("id", F.lit(-(1 << 63))).alias("key")), "key")
    texts = stored(texts.select("digest", "text").mapInArrow(_meant, "digest binary, text binary"), "near-texts")

    # Rounds: in each bucket whose members are still apart, the most central one that hasn't led yet is compared with all.
    found, apart = None, members.withColumn("comp", F.col("digest"))
    for _ in range(ROUNDS):
        leads = apart.groupBy("key").agg(F.max(F.struct("central", "digest", "comp")).alias("lead"))
        led = apart.join(leads, "key")
        stars = led.filter(F.col("comp") != F.col("lead.comp")).select(F.col("digest").alias("a"), F.col("lead.digest").alias("b")).distinct()
        new = stored(_links(stars, texts, percent), "near-links")
        found = components(_joined(found, new))
        rest = led.filter(F.col("digest") != F.col("lead.digest")).drop("lead", "comp").join(found.withColumnRenamed("node", "digest"), "digest", "left").withColumn("comp", F.coalesce("root", "digest")).drop("root")
        open_ = rest.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key")
        apart = stored(rest.join(open_, "key"), "near-open")
        if new.isEmpty() or apart.isEmpty():
            break
    labelled = apart.select("key", "digest", "comp", "n", "m")
    small = _across(labelled.filter(F.col("m") <= SMALL_BUCKET).drop("m").withColumn("pos", F.lit(0).cast("long")), percent)
    large = labelled.filter(F.col("m") > SMALL_BUCKET).select("digest", "comp", "n").distinct()
    if large.isEmpty():
        pairs = small
    else:
        large = large.join(texts, "digest")
        counts = large.select("text").mapInArrow(_sketch, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
        prefixes = large.mapInArrow(_prefixes(counts["slot"].to_numpy(), counts["n"].to_numpy(), percent), "digest binary, comp binary, n long, key long, pos long")
        pairs = small.union(_across(stored(prefixes, "near-prefixes"), percent)).distinct()
    more = stored(_links(pairs, texts, percent), "near-links")
    if not more.isEmpty():
        found = components(_joined(found, more))

    rows = signed.select("id", "n", "digest").join(found.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = rows.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("id").alias("least"))
    rows = rows.join(least, "root", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _meant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each digest whose text has the digest it was joined by; others only share an id."""
    seen: set[bytes] = set()
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            good = []
            for d, s in zip(part.column("digest").to_pylist(), shingle_sets(part.column("text").to_pylist())):
                good.append(d not in seen and d == _digest(s))
                if good[-1]:
                    seen.add(d)
            yield part.filter(pa.array(good, pa.bool_()))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of near-duplicates, with all their columns.

    Rows that share an id stay or go together; rows without an id stay.
    """
    (gone_id,) = fresh(docs, "gone_id")
    gone = near_groups(docs, id_col, text_col, percent).groupBy(F.col(id_col).alias(gone_id)).agg(F.max("kept").alias("kept")).filter(~F.col("kept")).select(gone_id)
    return docs.join(gone, docs[id_col] == F.col(gone_id), "left_anti")
