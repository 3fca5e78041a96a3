"""Embedding near-duplicates by product quantisation: inverted lists with residual codes, a bound from leading dimensions and
table look-up distances over sufficient probes, and exact cosine on what they leave."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import release, stored

#: Links have at least this cosine.
COSINE = 0.95
#: The index is fitted on about so many vectors, chosen by a hash; all vectors are indexed.
SAMPLE = 20_000
MAX_LISTS, SUBSPACES, CODES, ROUNDS = 4096, 8, 256, 8
#: Vectors of a block, of 64 numbers each; longer ones make smaller blocks. Two blocks meet in one task.
BLOCK = 65_536
#: Tables below ``SMALL`` blocks are cut into so many, of at least ``LEAST`` vectors.
SMALL, LEAST = 4, 2048
#: Directions of the bound that goes before the look-ups; queries and vectors of a list that meet at once.
LEAD, TILE = 23, 2048
#: Slack of single-precision distances; it only adds candidates.
SLACK = 1e-3


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (centers * centers).sum(1) - 2 * (x @ centers.T)
    best = d.argmin(1)
    return best, d


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centers = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        best, _ = _nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, best, x)
        counts = np.bincount(best, minlength=len(centers))
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers


@dataclass
class PqIndex:
    centers: np.ndarray  # lists x dimension
    books: list[np.ndarray]  # for each subspace, codes x its dimensions
    cuts: list[tuple[int, int]]
    axes: np.ndarray  # dimension x directions in which the sample varies most

    @staticmethod
    def fit(x: np.ndarray, lists: int, seed: int = 4) -> PqIndex:
        rng = np.random.default_rng(seed)
        centers = _kmeans(x, min(lists, len(x)), rng)
        rest = x - centers[_nearest(x, centers)[0]]
        ends = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
        cuts = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
        axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :LEAD]
        return PqIndex(centers, [_kmeans(rest[:, a:b], min(CODES, len(x)), rng) for a, b in cuts], cuts, axes)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, d = _nearest(x, self.centers)
        return best, d

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and how far each decoded vector lies from its vector."""
        rest = x - self.centers[lists]
        codes = np.stack([_nearest(rest[:, a:b], book)[0] for (a, b), book in zip(self.cuts, self.books)], 1)
        miss = sum(((rest[:, a:b] - book[codes[:, m]]) ** 2).sum(1) for m, ((a, b), book) in enumerate(zip(self.cuts, self.books)))
        return codes.astype(np.uint8), np.sqrt(miss)

    def probes(self, x: np.ndarray, own: np.ndarray, radius: float) -> np.ndarray:
        """Whether each list (row) can hold a vector within ``radius`` of each of ``x``: whether that reaches the list's side
        of the bisecting plane."""
        c2 = (self.centers * self.centers).sum(1)
        between = np.sqrt(np.maximum(c2[:, None] + c2[None] - 2 * self.centers @ self.centers.T, 0)).astype(np.float32)
        d = c2.astype(np.float32)[:, None] - 2 * (self.centers.astype(np.float32) @ x.T.astype(np.float32))
        at = np.arange(len(x))
        hit = d - d[own, at] <= between[:, own] * np.float32(2 * radius) + np.float32(SLACK)
        hit[own, at] = True
        return hit

    def lead(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors in the leading directions, and the length of the rest: their products are never below the cosines."""
        a = x @ self.axes
        return np.column_stack([a, np.sqrt(np.maximum(1 - (a * a).sum(1), 0))]).astype(np.float32)

    def distances(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Of queries to decoded vectors of list ``at``, squared, each a sum of looked-up parts."""
        rest = queries - self.centers[at]
        out = np.zeros((len(queries), len(codes)), np.float32)
        for m, ((a, b), book) in enumerate(zip(self.cuts, self.books)):
            part = rest[:, a:b]
            table = (part * part).sum(1)[:, None] + (book * book).sum(1)[None] - 2 * part @ book.T
            out += table.astype(np.float32)[:, codes[:, m]]
        return out


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest, length and bytes of each vector that can link; null for the others. Vectors that single precision holds are
    kept in it."""
    for batch in batches:
        digests, vectors, widths = [], [], []
        for v in batch.column("v").to_pylist():
            x = None if v is None or None in v else np.array(v, np.float64)
            good = x is not None and np.isfinite(x).all() and x.any()
            raw = (x + 0.0).astype("<f8") if good else None
            vectors.append(_short(raw).tobytes() if good else None)
            widths.append(len(raw) if good else None)
            digests.append(hashlib.blake2b(raw.tobytes(), digest_size=16).digest() if good else None)
        yield pa.record_batch([batch.column("id"), pa.array(digests, pa.binary()), pa.array(widths, pa.int32()), pa.array(vectors, pa.binary())], names=["id", "digest", "width", "v"])


def _short(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        short = x.astype("<f4")
    return short if (short == x).all() else x


def _rows(raw: list[bytes], width: int) -> np.ndarray:
    """Vectors of one row each, in single or double precision."""
    return np.stack([np.frombuffer(r, "<f4" if len(r) == 4 * width else "<f8") for r in raw]).astype(np.float64)


#: A part of a block: what is told of its vectors, each column one after the other.
PART = "block int, digests binary, n binary, lists binary, codes binary, miss binary, short boolean, v binary"


def _index(index: PqIndex, blocks: int, width: int) -> Callable:
    """List, codes and decoding error of each class, as parts of blocks. The digest, which is random, says which block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            digests, n = batch.column("digest").to_pylist(), batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            raw = _rows(batch.column("v").to_pylist(), width)
            told = []
            for i in range(0, len(raw), 2048):
                x = unit(raw[i : i + 2048])
                own, _ = index.assign(x)
                told.append((own.astype(np.int32), *index.encode(x, own)))
            lists, codes, miss = (np.concatenate(c) for c in zip(*told))
            at = np.array([int.from_bytes(d[:8], "little") % blocks for d in digests])
            parts = []
            for b in np.unique(at):
                k = np.flatnonzero(at == b)
                v = _short(raw[k])
                parts.append((int(b), b"".join(digests[j] for j in k), n[k].tobytes(), lists[k].tobytes(), codes[k].tobytes(), miss[k].astype(np.float32).tobytes(), v.itemsize == 4, v.tobytes()))
            types = [pa.int32(), *[pa.binary()] * 5, pa.bool_(), pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*parts), types)], names=[c.split()[0] for c in PART.split(", ")])

    return run


@dataclass
class _Block:
    """Classes of a block in order of their lists."""

    digests: np.ndarray
    n: np.ndarray
    lists: np.ndarray
    codes: np.ndarray
    miss: np.ndarray
    x: np.ndarray

    @staticmethod
    def of(parts: pa.Table, width: int) -> _Block:
        flat = lambda name, kind: np.frombuffer(b"".join(parts.column(name).to_pylist()), kind)
        lists = flat("lists", np.int32)
        order = np.argsort(lists, kind="stable")
        short = parts.column("short").to_pylist()
        x = np.concatenate([np.frombuffer(v, "<f4" if s else "<f8").reshape(-1, width) for s, v in zip(short, parts.column("v").to_pylist())])[order]
        return _Block(flat("digests", "V16")[order], flat("n", np.int64)[order], lists[order], flat("codes", np.uint8).reshape(len(lists), -1)[order], flat("miss", np.float32)[order], unit(x.astype(np.float64)))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node number of each node's component under links (a, b)."""
    label = np.arange(n)
    while True:
        old = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = np.minimum(label, label[label])
        if (label == old).all():
            return label


class _Found:
    """Links of a task: their numbers by node, and a forest that connects what they connect. Links themselves don't stay."""

    def __init__(self, nodes: int) -> None:
        self.counts, self.label = np.zeros(nodes, np.int64), np.arange(nodes)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> None:
        np.add.at(self.counts, a, n_b)
        np.add.at(self.counts, b, n_a)
        self.links.append((a, b))
        self.held += len(a)
        if self.held > 1 << 20:
            self.fold()

    def fold(self) -> np.ndarray:
        nodes = np.arange(len(self.label))
        a, b = (np.concatenate(side) for side in zip((nodes, self.label), *self.links))
        self.label, self.links, self.held = _forest(a, b, len(nodes)), [], 0
        return self.label


def _cosines(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the pairs (a, b) of rows of ``q`` and ``x``, by one product where most rows are paired."""
    if len(q) * len(x) <= 16 * len(a):
        return (q @ x.T)[a, b]
    return np.concatenate([np.einsum("ij,ij->i", q[a[j : j + 16_384]], x[b[j : j + 16_384]]) for j in range(0, len(a), 16_384)])


def _search(index: PqIndex, cosine: float, radius: float, width: int) -> Callable:
    """Links between two blocks, or within one: numbers of links, and enough links to connect all."""
    schema = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("root", pa.binary())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        asks = table.column("asks").combine_chunks()
        asked, held = table.filter(asks), table.filter(pa.compute.invert(asks))
        one = len({k.as_py() if hasattr(k, "as_py") else int(k) for k in key}) == 1
        if not len(asked) or not (one or len(held)):
            return schema.empty_table()
        q = _Block.of(asked, width)
        x = q if one else _Block.of(held, width)
        first = 0 if one else len(q.n)  # node of x's first vector
        reach = ((radius + SLACK + x.miss) ** 2).astype(np.float32)
        lead_q, lead_x = index.lead(q.x), np.ascontiguousarray(index.lead(x.x).T)
        lists = np.unique(x.lists)
        ends = np.searchsorted(x.lists, lists, "right")
        found, room = _Found(first + len(x.n)), np.empty(TILE * TILE, np.float32)
        step = max(TILE, (1 << 23) // len(index.centers))
        for i in range(0, len(q.n), step):
            hit = index.probes(q.x[i : i + step], q.lists[i : i + step], radius)
            for at, start, end in zip(lists, [0, *ends[:-1]], ends):
                rows = np.flatnonzero(hit[at]) + i
                if one:
                    rows = rows[rows < end]  # each pair from one side only
                for j in range(0, len(rows), TILE):
                    part = rows[j : j + TILE]
                    some = lead_q[part]
                    for k in range(start, end, TILE):
                        ahead = lead_x[:, k : min(end, k + TILE)]
                        bound = np.matmul(some, ahead, out=room[: len(some) * ahead.shape[1]].reshape(len(some), -1))
                        if bound.max() < cosine - SLACK:
                            continue
                        near = bound >= cosine - SLACK
                        a, b = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                        near, a, b = near[np.ix_(a, b)], part[a], b + k
                        for m in range(0, len(a), 128):
                            near[m : m + 128] &= index.distances(q.x[a[m : m + 128]], at, x.codes[b]) <= reach[b] + SLACK
                        if one:
                            near &= a[:, None] < b
                        left, right = np.nonzero(near)
                        if not len(left):
                            continue
                        good = _cosines(q.x[a], x.x[b], left, right) >= cosine
                        left, right = a[left[good]], b[right[good]]
                        found.add(left, right + first, q.n[left], x.n[right])
        label, linked = found.fold(), np.flatnonzero(found.counts)
        every = q.digests if one else np.concatenate([q.digests, x.digests])
        named = lambda nodes: pa.array([d.tobytes() for d in every[nodes]], pa.binary())
        return pa.table([named(linked), pa.array(found.counts[linked]), named(label[linked])], schema=schema)

    return run


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links`` (other rows of at least this cosine), ``component_id``, ``kept``.

    Equal vectors form one class, which counts for its rows. Classes are dealt at random to blocks of bounded size, and each
    two blocks meet in one task, which holds nothing else. There each class asks all lists that can hold a vector within
    the distance that the cosine stands for; products in the leading directions and look-up distances, less the stored
    decoding error, bound the true ones, so what they prune cannot be a link. Tasks return numbers of links and a spanning
    forest, never the links. A job ships each class at most twice, and what it shipped goes before the next job.

    Vectors link within their own length; each length has its own index.

    Edge cases: vectors that are null, zero, or that hold a null or non-finite component link with nothing; rows with a null id take part but never name a component unless all its ids are null; repeated
    rows link with each other; an empty table gives an empty one.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    seen = rows.mapInArrow(_classes, "id long, digest binary, width int, v binary")
    named = stored(seen.select("id", "digest"), "vectors")
    classes = stored(seen.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("width").alias("width"), F.min("v").alias("v")), "vector-classes")
    totals = classes.groupBy("width").count().orderBy("width").collect()  # one row per length
    if totals:
        links = reduce(DataFrame.union, [_linked(classes.filter(F.col("width") == r["width"]), r["width"], r["count"], cosine, sample) for r in totals])
        own = links.groupBy("digest").agg(F.sum("n").alias("others"))
        found = components(links.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    else:
        own = classes.select("digest", F.lit(0).cast("long").alias("others"))
        found = classes.select(F.col("digest").alias("node"), F.col("digest").alias("root"))
    facts = classes.select("digest", (F.col("n") - 1).alias("copies")).join(own, "digest", "left").join(found.withColumnRenamed("node", "digest"), "digest", "left")
    facts = facts.select("digest", (F.col("copies") + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "digest").alias("root"))
    joined = named.select("id", "digest").join(facts, "digest", "left")
    least = joined.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("id").alias("least"))
    out = joined.join(least, "root", "left").withColumn("component_id", F.when(F.col("root").isNotNull(), F.col("least")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _linked(classes: DataFrame, width: int, total: int, cosine: float, sample: int) -> DataFrame:
    """(digest, n, root) from each two blocks: links counted there, and a node that the digest is connected to."""
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    draw = F.pmod(F.xxhash64("digest"), F.lit(1 << 30)) / float(1 << 30)
    drawn = classes.filter(draw < min(1.0, sample / total)).select("digest", "v").toPandas().sort_values("digest")
    if drawn.empty:
        drawn = classes.select("digest", "v").orderBy("digest").limit(1).toPandas()
    index = PqIndex.fit(unit(_rows([bytes(v) for v in drawn["v"]], width)), int(np.clip(round(total**0.5 / 2), 1, MAX_LISTS)))
    blocks = max(-(-total // max(1, BLOCK * 64 // max(64, width))), min(SMALL, -(-total // LEAST)))
    parts = stored(classes.select("digest", "v", "n").mapInArrow(_index(index, blocks, width), PART), "vector-index")
    search = _search(index, cosine, radius, width)
    links = [stored(met.groupBy("a", "b").applyInArrow(search, "digest binary, n long, root binary"), "vector-links") for met in _meetings(parts, blocks)]
    release(parts)
    return reduce(DataFrame.union, links)


def _meetings(parts: DataFrame, blocks: int) -> Iterator[DataFrame]:
    """Tables in which each block (a) meets the one that lies so many places after it (b), around the circle; every two blocks
    meet once."""
    for ahead in range(blocks // 2 + 1):
        other = F.pmod(F.col("block") + ahead, F.lit(blocks)).cast("int")
        before = F.pmod(F.col("block") - ahead, F.lit(blocks)).cast("int")
        asked = parts.select(F.col("block").alias("a"), other.alias("b"), F.lit(True).alias("asks"), "*")
        held = parts.select(before.alias("a"), F.col("block").alias("b"), F.lit(False).alias("asks"), "*")
        both = asked.union(held) if ahead else asked
        yield both.filter(F.col("a") < ahead) if ahead and 2 * ahead == blocks else both
