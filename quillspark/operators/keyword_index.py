"""Stored keyword index: substrings bounded by their grams, blocks of texts that cannot reach a query's best hits are skipped.

An index is one table, a row a block of BLOCK texts in order of law and uid: the texts, and beside them in columns of their
own what bounds their scores (for each gram the most it occurs in a thousand characters of a text, laws, grams of uids and
headers). A search reads the bounds of all blocks and the texts of few; the table stays for the next search. Grams are all
places of LONG characters and, for words that are shorter, of three; the bounds take about as much room as the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.scratch import written
from . import retrieval

#: Texts of a block; blocks whose texts are read first for a query; blocks up to which a search names them to the scan.
BLOCK, FIRST, NAMED = 64, 2, 5_000
#: Characters of a gram.
LONG = 5

_ROW = "block long, first_uid string, texts int, laws array<string>, names binary, grams binary, density binary, uids array<string>, law_tags array<string>, contents array<string>, headers array<string>"
_BOUNDS = ["block", "first_uid", "laws", "names", "grams", "density"]


def _places(text: str, size: int) -> np.ndarray:
    """A hash of 32 bits for each place of ``size`` characters. Equal hashes of others only loosen a bound."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = np.full(max(len(points) - size + 1, 0), size, np.uint32)
    for j in range(size if len(h) else 0):
        h = (h ^ points[j : j + len(h)]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h


def text_grams(text: str) -> np.ndarray:
    return np.concatenate([_places(text, 3), _places(text, LONG)])


def word_grams(word: str) -> np.ndarray:
    """The grams that a text with this word has; none for words below three characters."""
    return _places(word, LONG if len(word) >= LONG else 3)


def _block(number: int, rows: list[tuple]) -> list:
    found: list[np.ndarray] = []
    per_text: list[np.ndarray] = []
    for _, _, content, _ in rows:
        low = (content or "").lower()
        grams, counts = np.unique(text_grams(low), return_counts=True)
        found.append(grams)
        per_text.append(np.nextafter((counts * 1000 / max(len(content or ""), 1)).astype(np.float32), np.float32(np.inf)))
    grams, at = np.unique(np.concatenate(found), return_inverse=True)
    density = np.zeros(len(grams), np.float32)
    np.maximum.at(density, at, np.concatenate(per_text))
    names = np.unique(np.concatenate([text_grams(f"{u.lower()}\0\0\0\0{(h or '').lower()}") for u, _, _, h in rows]))
    uids, laws, contents, headers = map(list, zip(*rows))
    return [number, min(uids), len(rows), sorted({x for x in laws if x is not None}), names.tobytes(), grams.tobytes(), density.tobytes(), uids, laws, contents, headers]


def build_keyword_index(chunks: DataFrame, path: str, text: str = "content", header: str | None = None) -> None:
    """Write the index of chunks (uid, law_tag, text): ranges of laws and uids, sorted, cut into blocks. Rows without a uid are left
    out; repeated uids are separate texts."""
    schema = to_arrow_schema(StructType.fromDDL(_ROW))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []
        give = lambda: pa.record_batch([pa.array([v], f.type) for v, f in zip(_block(number, held), schema)], schema=schema)
        for row in retrieval.singly(batches):
            held.append(row)
            if len(held) == BLOCK:
                yield give()
                number, held = number + 1, []
        if held:
            yield give()

    rows = written(chunks.filter("uid is not null").select("uid", "law_tag", text, (F.col(header) if header else F.lit("")).alias("_h")), "texts")  # ranges are sampled from it
    ranges = rows.repartitionByRange("law_tag", "uid").sortWithinPartitions("law_tag", "uid")
    ranges.mapInArrow(cut, _ROW).write.mode("overwrite").option("parquet.block.size", 4 << 20).parquet(path)


class _Bounds:
    """For one list of queries: the most that a text of a block can score for each of them."""

    def __init__(self, queries: list[tuple]) -> None:
        self.total = len(queries)
        words = sorted({w for _, ws, _, _ in queries for w in ws})
        place = {w: i for i, w in enumerate(words)}
        self.asker = np.array([q for q, (_, ws, _, _) in enumerate(queries) for _ in ws], int)
        self.asked = np.array([place[w] for _, ws, _, _ in queries for w in ws], int)
        self.words = self._cut(words)
        articles = sorted({a.lower() for _, _, cited, _ in queries for a in cited})
        places = {a: i for i, a in enumerate(articles)}
        self.cites = [(q, places[a.lower()]) for q, (_, _, cited, _) in enumerate(queries) for a in cited]
        self.articles = self._cut(articles)
        self.laws = [laws for _, _, _, laws in queries]

    @staticmethod
    def _cut(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all grams, where each word's begin, which words are too short to have any)"""
        grams = [word_grams(w) for w in words]
        lengths = np.array([len(g) for g in grams], int)
        flat = np.concatenate(grams) if words else np.empty(0, np.uint32)
        return flat, np.cumsum(lengths) - lengths, lengths == 0

    @staticmethod
    def _least(cut: tuple[np.ndarray, np.ndarray, np.ndarray], known: np.ndarray, values: np.ndarray) -> np.ndarray:
        """For each word the least value of its grams; 0 where one is missing, infinite where it has none."""
        flat, begins, short = cut
        out = np.full(len(short), np.inf, np.float32)
        if len(flat):
            at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
            of = np.where(known[at] == flat, values[at], 0).astype(np.float32) if len(known) else np.zeros(len(flat), np.float32)
            long = np.flatnonzero(~short)
            out[long] = np.minimum.reduceat(of, begins[long])
        return out

    def of(self, laws: list[str], names: bytes, grams: bytes, density: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, article match, law match) at most, for each query; score -1 where no keyword can occur."""
        per_word = self._least(self.words, np.frombuffer(grams, np.uint32), np.frombuffer(density, np.float32))
        known = np.frombuffer(names, np.uint32)
        in_names = self._least(self.words, known, np.ones(len(known), np.float32)) > 0
        dense = np.bincount(self.asker, per_word[self.asked].astype(np.float64), self.total)
        heads = np.bincount(self.asker, (in_names & (per_word > 0))[self.asked], self.total)
        article, law = np.zeros(self.total, bool), np.array([not x.isdisjoint(laws) for x in self.laws], bool)
        named = self._least(self.articles, known, np.ones(len(known), np.float32)) > 0
        for q, a in self.cites:
            article[q] |= named[a]
        score = np.floor(np.minimum(0.58, 0.30 + 0.10 * dense + 0.08 * heads + 0.06 + 0.20 * article + 0.04 * law) * 1e6 + 0.5) / 1e6
        return np.where(dense > 0, score, -1.0), article, law


def _first_blocks(sent):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        bounds, best = _Bounds(queries), [[] for _ in queries]
        least = np.full(len(queries), -np.inf)
        for batch in batches:
            for block, first, laws, *data in retrieval.singly([batch], 1):
                score, article, law = bounds.of(laws, *data)
                for q in np.flatnonzero((score >= least) & (score >= 0)).tolist():
                    item = (score[q], article[q], law[q], _Backward(first), block)
                    if len(best[q]) < FIRST:
                        heappush(best[q], item)
                    elif item > best[q][0]:
                        heapreplace(best[q], item)
                    if len(best[q]) == FIRST:
                        least[q] = best[q][0][0]
        rows = [(q, block, float(s), bool(a), bool(l), first.text) for q, held in enumerate(best) for s, a, l, first, block in held]
        columns = zip(*rows) if rows else [[]] * 6
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.float64(), pa.bool_(), pa.bool_(), pa.string()))], names=["q", "block", "score", "article", "law", "first_uid"])

    return run


class _Backward:
    """A text in falling order."""

    __slots__ = ("text",)

    def __init__(self, text: str) -> None:
        self.text = text

    def __lt__(self, other: _Backward) -> bool:
        return self.text > other.text

    def __eq__(self, other: object) -> bool:
        return self.text == other.text


def _open_blocks(sent):  # noqa: ANN001, ANN202
    """Blocks that may hold a better hit than a query's k-th so far, and were not read for it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, kth, read = sent.value
        bounds = _Bounds(queries)
        score_k = np.array([x[0] for x in kth])
        for batch in batches:
            out = []
            for block, first, laws, *data in retrieval.singly([batch], 1):
                score, article, law = bounds.of(laws, *data)
                for q in np.flatnonzero((score >= score_k) & (score >= 0)).tolist():
                    s, a, l, uid = kth[q]
                    better = (score[q], article[q], law[q]) > (s, a, l) or (score[q], article[q], law[q]) == (s, a, l) and first < uid
                    if better and block not in read[q]:
                        out.append((q, block))
            columns = zip(*out) if out else [[]] * 2
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64()))], names=["q", "block"])

    return run


def _scored(sent, k: int, schema: pa.Schema):  # noqa: ANN001, ANN202
    """The best k hits of each query among the blocks that are read for it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        scorer, best = retrieval.Scorer(queries), retrieval._Best(len(queries), k)
        for batch in batches:
            for who, uids, laws, contents, headers in retrieval.singly([batch], 1):  # a row is a block of texts
                asks = np.zeros(len(queries), bool)
                asks[who] = True
                scored = scorer.scores(list(zip(uids, laws, contents, headers)))
                keep = asks[scored[1]]
                best.add(uids, *(x[keep] for x in scored))
        yield retrieval.best_batch(best, queries, k, schema)

    return run


def indexed_search(spark: SparkSession, path: str, keywords: DataFrame, k: int = 10, articles: DataFrame | None = None, laws: DataFrame | None = None, counts: dict | None = None) -> DataFrame:
    """The hits of ``retrieval.keyword_search``, the same rows, from a stored index.

    For each query the FIRST blocks of highest bound are read; its k-th hit there is what a further block's bound has to
    beat. ``counts``, if given, is filled with the number of texts, how many were read (for any query), and the mean share
    that was compared with a query.
    """
    kind, found, bounds = dict(keywords.dtypes)["query_id"], None, spark.read.parquet(path).select(*_BOUNDS)
    schema = retrieval.hit_schema(kind)
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    order = (F.desc("similarity"), F.desc("article_match"), F.desc("law_match"), F.col("uid"))
    for part in retrieval._parts(keywords.filter("keyword <> ''")):
        queries = retrieval.asked_rows(part, articles, laws)
        if not queries:
            continue
        plan = spark.sparkContext.broadcast(queries)

        def hits(pairs: DataFrame, plan=plan) -> DataFrame:  # noqa: ANN001
            asks = pairs.groupBy("block").agg(F.collect_set("q").alias("who"))  # QUERY_ROWS at most
            named = [r[0] for r in pairs.select("block").distinct().limit(NAMED + 1).collect()]
            texts = spark.read.parquet(path).select("block", "uids", "law_tags", "contents", "headers")
            if len(named) <= NAMED:  # row groups without them are not read
                texts = texts.filter(F.col("block").isin(named))
            return texts.join(asks, "block").select("who", "uids", "law_tags", "contents", "headers").mapInArrow(_scored(plan, k, arrow), schema)

        ranked = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.desc("article"), F.desc("law"), "first_uid"))
        first = written(bounds.mapInArrow(_first_blocks(plan), "q int, block long, score double, article boolean, law boolean, first_uid string").withColumn("n", ranked).filter(F.col("n") <= FIRST).select("q", "block"), "blocks")
        best = written(retrieval.top(hits(first), k, *order), "hits")
        places = {q[0]: i for i, q in enumerate(queries)}
        kth, read = [(-1.0, False, False, "")] * len(queries), [set() for _ in queries]
        last = best.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("n") == k)
        for r in last.collect():  # a row a query
            kth[places[r["query_id"]]] = (r["similarity"], r["article_match"], r["law_match"], r["uid"])
        for r in first.collect():  # FIRST rows a query
            read[r["q"]].add(r["block"])
        more = written(bounds.mapInArrow(_open_blocks(spark.sparkContext.broadcast((queries, kth, read))), "q int, block long"), "blocks")
        all_hits = retrieval.top(best.unionByName(hits(more)), k, *order)
        found = all_hits if found is None else found.unionByName(all_hits)
        if counts is not None:
            pairs = first.unionByName(more)
            sizes = spark.read.parquet(path).select("block", "texts")
            per = pairs.join(sizes, "block").agg(F.sum("texts").alias("compared")).first()["compared"] or 0
            once = pairs.select("block").distinct().join(sizes, "block").agg(F.sum("texts").alias("read")).first()["read"] or 0
            total = sizes.agg(F.sum("texts")).first()[0] or 0
            counts |= {"texts": total, "read": counts.get("read", 0) + once, "compared": per / max(total, 1) / len(queries)}
    if found is None:
        return keywords.select("query_id").limit(0).select("query_id", F.lit("").alias("uid"), F.lit(0.0).alias("similarity"), F.lit("keyword").alias("origin"))
    return found.select("query_id", "uid", "similarity", F.lit("keyword").alias("origin"))
