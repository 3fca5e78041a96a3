"""Batch retrieval: vector and keyword search, rule-forced hits, parents, graph expansion, fusion, context, routing.

Hits are rows (query_id, uid, similarity, origin). Every ranking ends in the uid, so results are repeatable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import batched, chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import vectors
from ..functions.spread import spread
from ..sources.scratch import written
from . import graph

#: Rows of the query side that a nested-loop join may broadcast; larger sets of queries are searched in parts.
QUERY_ROWS = 10_000
#: Keywords of one automaton; larger vocabularies are counted in parts.
WORDS = 100_000
#: Similarities that the steps of the hybrid search assign, and the threshold below which a live lookup is asked for.
FORCED, GRAPH, PARENT, THRESHOLD = 0.95, 0.82, 0.75, 0.72


def top(hits: DataFrame, k: int | Column, *order: Column) -> DataFrame:
    """The first k hits per query: by similarity, then uid, unless another order is given."""
    by = order or (F.desc("similarity"), F.col("uid"))
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).filter(F.col("_n") <= k).drop("_n")


def clamp_k(k: int | None) -> int:
    return max(1, min(k or 10, 50))


def _parts(queries: DataFrame) -> list[DataFrame]:
    """The query side in parts of QUERY_ROWS queries at most, by a hash of query_id."""
    parts = -(-queries.select("query_id").distinct().count() // QUERY_ROWS) or 1
    return [queries if parts == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) for i in range(parts)]


def match_chunks(queries: DataFrame, chunks: DataFrame, k: int | None = 10, by: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """Exact vector search: for each of the stated queries (query_id, embedding) the k chunks (uid, embedding) of
    highest cosine, rounded to 6 digits.

    by: columns of both sides that must be equal, as a law or a source; where: a condition on the chunks that is applied
    before the search, as validity or visibility. The query side goes to the tasks in parts of QUERY_ROWS at most. A task
    compares blocks of vectors by matrix products and gives out at most k rows a query, so what is shuffled doesn't grow
    with the pairs.
    """
    keys = F.array(*(F.col(c).cast("string") for c in by)) if by else F.array().cast("array<string>")
    vector = F.col("embedding").cast("array<double>")
    asked = queries.select("query_id", keys.alias("_by"), vector.alias("_v")).filter("_v is not null")
    schema = f"query_id {dict(queries.dtypes)['query_id']}, uid {dict(chunks.dtypes)['uid']}, similarity double"
    rows = (chunks if where is None else chunks.filter(where)).select("uid", keys.alias("_by"), vector.alias("_v")).filter("_v is not null")
    found, k = None, clamp_k(k)
    for part in _parts(asked):
        plan = chunks.sparkSession.sparkContext.broadcast(_Asked(part.collect()))  # QUERY_ROWS at most
        best = top(spread(rows).mapInArrow(_nearest(plan, k, to_arrow_schema(StructType.fromDDL(schema))), schema), k)
        found = best if found is None else found.unionByName(best)
    return found.withColumn("origin", F.lit("vector"))


class _Asked:
    """Queries by what has to be equal (the columns asked for, the vectors' length): their places and unit vectors."""

    def __init__(self, rows: list) -> None:
        self.ids, groups = [r[0] for r in rows], {}
        for place, (_, key, v) in enumerate(rows):
            if None not in key and None not in v:
                groups.setdefault((*key, len(v)), []).append(place)
        self.groups = {}
        for key, places in groups.items():
            unit, good = units(np.array([rows[i][2] for i in places], np.float64).reshape(len(places), key[-1]))
            self.groups[key] = (np.array(places)[good], unit)


def units(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a matrix at unit length, and which rows these are; those of length 0 are left out."""
    with np.errstate(all="ignore"):
        length = np.sqrt(np.einsum("ij,ij->i", m, m))
        good = ~(length <= 0)
        return m[good] / length[good, None], good


#: Pairs that a task compares at once and, at most, holds before it cuts them to the best.
PAIRS = 250_000


class _Closest:
    """The first k hits of each query among the chunks of a task: by similarity, then uid."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.least, self.uids, self.pending = k, np.full(queries, -np.inf), [], 0
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, places: np.ndarray, asked: np.ndarray, uids: list, given: np.ndarray) -> None:
        step = max(1, PAIRS // max(len(places), 1))
        for a in range(0, len(given), step):
            with np.errstate(all="ignore"):
                s = asked @ given[a : a + step].T
                q, c = np.nonzero(~(s < (self.least[places] - 2e-6)[:, None]))  # what is not a number counts as most, as in SQL
                s = s[q, c]
                s = np.copysign(np.floor(np.abs(s) * 1e6 + 0.5) / 1e6, s)
            names, c = np.unique(c, return_inverse=True)
            self.held.append((places[q], c + len(self.uids), s))
            self.uids += [uids[a + i] for i in names.tolist()]
            self.pending += len(q)
            if self.pending >= PAIRS:
                self.cut()

    def cut(self) -> None:
        q, c, s = (np.concatenate(x) for x in zip(*self.held)) if self.held else (np.empty(0, int), np.empty(0, int), np.empty(0))
        order = sorted(range(len(self.uids)), key=lambda i: (self.uids[i] is not None, self.uids[i] or ""))
        rank = np.empty(len(order), int)
        rank[order] = np.arange(len(order))
        worth = np.where(np.isnan(s), np.inf, s)
        by = np.lexsort((rank[c], -worth, q))
        q, c, s, worth = q[by], c[by], s[by], worth[by]
        begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
        place = np.arange(len(q)) - np.repeat(begin, np.diff(np.r_[begin, len(q)]))
        self.least[q[place == self.k - 1]] = worth[place == self.k - 1]
        keep = place < self.k
        names, at = np.unique(c[keep], return_inverse=True)
        self.uids, self.held, self.pending = [self.uids[i] for i in names.tolist()], [(q[keep], at, s[keep])], 0

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        self.cut()
        q, c, s = self.held[0]
        for a in range(0, len(q), 100_000):
            yield q[a : a + 100_000], c[a : a + 100_000], s[a : a + 100_000]


def _nearest(plan, k: int, schema: pa.Schema) -> Callable:  # noqa: ANN001  a broadcast
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = plan.value
        best = _Closest(len(asked.ids), k)
        for batch in batches:
            uids, keys, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
            values, ends = flat.to_numpy(zero_copy_only=False), np.cumsum(sizes)
            whole = np.ones(len(uids), bool)
            if flat.null_count:
                holes = np.r_[0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))]
                whole = holes[ends] == holes[ends - sizes]
            groups: dict[tuple, list[int]] = {}
            for i, (key, size) in enumerate(zip(keys, sizes.tolist())):
                if whole[i] and (*key, size) in asked.groups:
                    groups.setdefault((*key, size), []).append(i)
            for key, mine in groups.items():
                at = (ends - sizes)[mine][:, None] + np.arange(key[-1])
                given, good = units(values[at].astype(np.float64))
                best.add(*asked.groups[key], [uids[i] for i, g in zip(mine, good.tolist()) if g], given)
        for q, c, s in best.rows():
            columns = [asked.ids[i] for i in q.tolist()], [best.uids[i] for i in c.tolist()], s
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)

    return run


def list_count(vectors: int, most: int = 100) -> int:
    """How many lists an index of so many vectors has: as their square root grows, up to ``most``."""
    return max(1, min(most, round(vectors**0.5)))


def fit_lists(chunks: DataFrame, lists: int, sample: int = 20_000, seed: int = 5) -> DataFrame:
    """(list, center) of an inverted-list index, fitted by k-means on about ``sample`` unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = chunks.count()
    rows = chunks.select("uid", vectors.doubles("embedding").alias("_v")).withColumn("_l", vectors.norm(F.col("_v"))).filter("_l > 0")
    rows = rows.select("uid", array_to_vector(F.transform("_v", lambda x: x / F.col("_l"))).alias("features"))
    if n > sample:
        rows = rows.filter(F.pmod(F.xxhash64("uid"), F.lit(n)) < sample)
    model = KMeans(k=lists, seed=seed, maxIter=10).fit(rows)
    return chunks.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "list int, center array<double>")


def best_per_uid(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id", "uid").agg(F.max("similarity").alias("similarity"))


def source_priority(content_type: str, priorities: dict[str, Sequence[str]], default: Sequence[str]) -> Column:
    """The source types of a content type, in order."""
    out = F.array(*map(F.lit, default))
    for name, sources in priorities.items():
        out = F.when(F.col(content_type) == name, F.array(*map(F.lit, sources))).otherwise(out)
    return out


# --- keywords --------------------------------------------------------------------------------------------------------

def query_keywords(queries: DataFrame, text: str, stopwords: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(query_id, keyword): lower-case words that are no stopwords and longer than 3 or a synonym's term, and what the
    synonym table (term, expansion) adds."""
    words = queries.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([0-9a-z_áéíóúüñàèìòùâêîôûäëïöçß]+)"), 1))).alias("keyword"))
    words = words.join(stopwords.select(F.col("word").alias("keyword")).distinct(), "keyword", "left_anti")
    if synonyms is None:
        return words.filter(F.length("keyword") > 3)
    words = words.join(synonyms.withColumnRenamed("term", "keyword"), "keyword", "left").filter((F.length("keyword") > 3) | F.col("expansion").isNotNull())
    return words.select("query_id", F.explode(F.array_distinct(F.concat(F.array("keyword"), F.coalesce("expansion", F.array().cast("array<string>"))))).alias("keyword")).distinct()


#: Rows whose texts a task holds as Python strings at once, and rows it gives to Spark at once.
TEXT_ROWS, OUT_ROWS = 64, 20_000


def singly(batches: Iterator[pa.RecordBatch], rows: int = TEXT_ROWS) -> Iterator[tuple]:
    """The rows of batches, turned into Python values a few at a time, so that long texts don't lie in memory twice."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield from zip(*(c.to_pylist() for c in batch.slice(a, rows).columns))


class Words:
    """Words that run over a text together, in an automaton."""

    def __init__(self, words: Sequence[str]) -> None:
        self.automaton, self.sizes = ahocorasick.Automaton(), np.array([len(w) for w in words], int)
        for k, word in enumerate(words):
            self.automaton.add_word(word, k)
        if words:
            self.automaton.make_automaton()
        # Only a word that begins as it ends can overlap itself.
        self.overlaps = np.array([any(w.endswith(w[:i]) for i in range(1, len(w))) for w in words], bool)

    def occurrences(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words that occur: place of the text, of the word, how often without overlaps, where first."""
        met = [np.fromiter(chain.from_iterable(self.automaton.iter(t)) if len(self.sizes) else (), int) for t in texts]
        ends, key = (np.concatenate([m[i::2] for m in met]) if met else np.empty(0, int) for i in (0, 1))
        key += np.repeat(np.arange(len(met)), [len(m) // 2 for m in met]) * len(self.sizes)
        by = np.argsort(key, kind="stable")  # by text and word, then by end
        ends, key = ends[by], key[by]
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, int)
        n = np.diff(begin, append=len(key))
        row, k = np.divmod(key[begin], max(len(self.sizes), 1))
        for i in np.flatnonzero(self.overlaps[k] & (n > 1)).tolist():
            size, last, times = int(self.sizes[k[i]]), -1, 0
            for end in ends[begin[i] : begin[i] + n[i]].tolist():
                if end - size >= last:
                    last, times = end, times + 1
            n[i] = times
        return row, k, n, ends[begin] - self.sizes[k] + 1


def keyword_counts(chunks: DataFrame, keywords: DataFrame, text: str = "content", header: str | None = None) -> DataFrame:
    """(uid, keyword, n, first, in_header) of every keyword that occurs in a chunk, as a substring, lower-cased.

    n counts non-overlapping occurrences, first is the offset of the first. Keywords run over a text together, each once, in
    an automaton, so cost follows the text, not text x keywords. They go to the tasks in parts of WORDS at most, one pass
    over the texts a part.
    """
    words = keywords.filter("keyword <> ''").select("keyword").distinct()
    parts = -(-words.count() // WORDS)
    schema, found = "uid string, keyword string, n long, first long, in_header boolean", None
    for i in range(parts):
        part = words if parts == 1 else words.filter(F.pmod(F.xxhash64("keyword"), F.lit(parts)) == i)
        plan = chunks.sparkSession.sparkContext.broadcast(sorted(r[0] for r in part.collect()))  # about WORDS
        counts = spread(chunks.select("uid", text, F.col(header) if header else F.lit("").alias("_h"))).mapInArrow(_count(plan), schema)
        found = counts if found is None else found.unionByName(counts)
    return chunks.sparkSession.createDataFrame([], schema) if found is None else found


def _count(plan) -> Callable:  # noqa: ANN001  a broadcast
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = plan.value
        words = Words(vocabulary)
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
        give = lambda out: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], names=["uid", "keyword", "n", "first", "in_header"])
        out: list[tuple] = []
        for uid, body, head in singly(batches):
            top_ = (head or "").lower()
            seen = zip(*(x.tolist() for x in words.occurrences([(body or "").lower()])[1:]))
            out += [(uid, vocabulary[k], n, begin, vocabulary[k] in top_) for k, n, begin in seen]
            if len(out) >= OUT_ROWS:
                yield give(out)
                out = []
        yield give(out)

    return run


class _Best:
    """The first k hits of each query among the chunks of a task."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.held = k, [[] for _ in range(queries)]
        self.least, self.last = np.full(queries, -1), np.full(queries, "", object)  # worth and uid of the k-th

    def add(self, uids: Sequence[str], rows: np.ndarray, queries: np.ndarray, scores: np.ndarray, articles: np.ndarray, laws: np.ndarray) -> None:
        """Hits of the uids whose places ``rows`` gives."""
        worth = np.rint(scores * 1e6).astype(int) * 4 + articles * 2 + laws  # scores have six digits
        least = self.least[queries]
        good = worth > least
        if (same := worth == least).any():
            good[same] = self.last[queries[same]] > np.array(uids, object)[rows[same]]
        for r, q, s, a, l in zip(*(x[good].tolist() for x in (rows, queries, scores, articles, laws))):
            held = self.held[q]
            held.append((-s, not a, not l, uids[r]))
            if len(held) >= 4 * self.k + 16:
                held.sort()
                del held[self.k :]
                s, a, l, self.last[q] = held[-1]
                self.least[q] = round(-s * 1e6) * 4 + (not a) * 2 + (not l)


def keyword_search(chunks: DataFrame, keywords: DataFrame, k: int = 10, articles: DataFrame | None = None, laws: DataFrame | None = None, text: str = "content", header: str | None = None) -> DataFrame:
    """Keyword hits per query. chunks: uid, law_tag, text; keywords: (query_id, keyword); articles: (query_id, article)
    cited; laws: (query_id, law_tag).

    similarity = min(0.58, 0.30 + 0.10 density + 0.08 header hits + place + length + article + law), density being
    occurrences a thousand characters. Hits are added up and ranked where the chunk is read: a task gives out at most k
    rows a query, whatever its texts hold. What the queries ask goes to the tasks in parts of QUERY_ROWS queries.
    """
    found = None
    for part in _parts(keywords.filter("keyword <> ''")):
        rows = asked_rows(part, articles, laws)
        if not rows:
            continue
        plan = chunks.sparkSession.sparkContext.broadcast(rows)
        schema = hit_schema(dict(keywords.dtypes)["query_id"])
        hits = spread(chunks.select("uid", "law_tag", text, F.col(header) if header else F.lit("").alias("_h"))).mapInArrow(_rank(plan, k, to_arrow_schema(StructType.fromDDL(schema))), schema)
        ranked = top(hits, k, F.desc("similarity"), F.desc("article_match"), F.desc("law_match"), F.col("uid"))
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        found = keywords.select("query_id").limit(0).select("query_id", F.lit("").alias("uid"), F.lit(0.0).alias("similarity"))
    return found.select("query_id", "uid", "similarity", F.lit("keyword").alias("origin"))


class Scorer:
    """Scores of texts for a list of queries (id, keywords, cited articles, laws); keywords of all queries, and articles of
    all queries, each go through a text once, in an automaton."""

    def __init__(self, queries: list[tuple]) -> None:
        self.words = sorted({w for _, words, _, _ in queries for w in words})
        place, asking, self.total = {w: i for i, w in enumerate(self.words)}, [[] for _ in self.words], len(queries)
        self.by_law: dict[str, list[int]] = {}
        citing: dict[str, list[int]] = {}
        for q, (_, words, articles, laws) in enumerate(queries):
            for w in words:
                asking[place[w]].append(q)
            for law in laws:
                self.by_law.setdefault(law, []).append(q)
            for article in articles:
                citing.setdefault(article.lower(), []).append(q)
        self.laws = {law: np.array(who) for law, who in self.by_law.items()}
        # Who asks for a word: a stretch of one array a word.
        self.askers, self.counts = np.array([q for a in asking for q in a], int), np.array([len(a) for a in asking], int)
        self.starts, self.always = np.cumsum(self.counts) - self.counts, citing.pop("", [])
        self.together = Words(self.words)
        self.articles = ahocorasick.Automaton()
        for article, who in citing.items():
            self.articles.add_word(article, np.array(who))
        if citing:
            self.articles.make_automaton()

    def cited(self, uid: str, low: str) -> np.ndarray:
        """Which queries cite an article that the uid or the header names."""
        out = np.zeros(self.total, bool)
        out[self.always] = True
        if len(self.articles):
            for where in (uid.lower(), low):
                for _, who in self.articles.iter(where):
                    out[who] = True
        return out

    def score(self, uid: str, law: str | None, body: str | None, head: str | None) -> tuple[np.ndarray, ...] | None:
        """(queries, similarity, article match, law match) of the queries of which a keyword occurs; None if none does."""
        _, *found = self.scores([(uid, law, body, head)])
        return tuple(found) if len(found[0]) else None

    def scores(self, texts: Sequence[tuple]) -> tuple[np.ndarray, ...]:
        """(place, queries, similarity, article match, law match) of texts (uid, law, body, head), a few at a time."""
        row, k, n, first = self.together.occurrences([(body or "").lower() for _, _, body, _ in texts])
        by = np.argsort(-first, kind="stable")  # of a query's words the first in the text is written last
        row, k, n, first = row[by], k[by], n[by], first[by]
        lengths, low = self.counts[k], [(head or "").lower() for *_, head in texts]
        q = self.askers[np.repeat(self.starts[k] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
        q += np.repeat(row, lengths) * self.total
        begin = np.full(len(texts) * self.total, -1)
        begin[q] = np.repeat(first, lengths)
        cells = np.flatnonzero(begin >= 0)
        begin, times = begin[cells], np.bincount(q, np.repeat(n, lengths), len(texts) * self.total)[cells]
        heads = np.array([i * len(self.words) + w for i, h in enumerate(low) for w in {w for _, w in self.together.automaton.iter(h)}], int) if self.words else np.empty(0, int)
        in_head = np.isin(row * len(self.words) + k, heads)
        row, ids = np.divmod(cells, max(self.total, 1))
        size = np.array([len(body or "") for _, _, body, _ in texts], int)[row]
        score = 0.30 + 0.10 * (times * 1000 / np.maximum(size, 1)) + 0.08 * np.bincount(q, np.repeat(in_head, lengths), len(texts) * self.total)[cells]
        score += np.where(begin < 200, 0.06, np.where(begin < 500, 0.03, 0.0)) + np.where(size < 300, -0.14, np.where(size < 500, -0.07, 0.0))
        articles, laws = np.zeros((len(texts), self.total), bool), np.zeros((len(texts), self.total), bool)
        for i, (uid, law, _, _) in enumerate(texts):
            articles[i] = self.cited(uid, low[i])
            if law in self.laws:
                laws[i, self.laws[law]] = True
        articles, laws = articles[row, ids], laws[row, ids]
        score += 0.20 * articles + 0.04 * laws
        return row, ids, np.floor(np.minimum(0.58, score) * 1e6 + 0.5) / 1e6, articles, laws


def asked_rows(part: DataFrame, articles: DataFrame | None, laws: DataFrame | None) -> list[tuple]:
    """(query_id, keywords, articles, laws) of the queries of one part, in order of query_id."""
    ids = part.select("query_id").distinct()
    asked = part.groupBy("query_id").agg(F.collect_set("keyword").alias("keywords"))
    for name, side, column in (("articles", articles, "article"), ("laws", laws, "law_tag")):
        sets = ids.withColumn(name, F.array().cast("array<string>")) if side is None else side.join(ids, "query_id", "left_semi").groupBy("query_id").agg(F.collect_set(column).alias(name))
        asked = asked.join(sets, "query_id", "left")
    rows = asked.orderBy("query_id").collect()  # QUERY_ROWS at most
    return [(r["query_id"], sorted(r["keywords"]), sorted(r["articles"] or []), set(r["laws"] or [])) for r in rows]


def hit_schema(query_type: str) -> str:
    return f"query_id {query_type}, uid string, similarity double, article_match boolean, law_match boolean"


def best_batch(best: _Best, queries: list[tuple], k: int, schema: pa.Schema) -> pa.RecordBatch:
    out = [(queries[q][0], uid, -s, not a, not l) for q, held in enumerate(best.held) for s, a, l, uid in sorted(held)[:k]]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, schema)], schema=schema)


def _rank(plan, k: int, schema: pa.Schema) -> Callable:  # noqa: ANN001  a broadcast
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = plan.value
        scorer, best = Scorer(queries), _Best(len(queries), k)
        for texts in batched(singly(batches), TEXT_ROWS):
            best.add([uid for uid, *_ in texts], *scorer.scores(texts))
        yield best_batch(best, queries, k, schema)

    return run


# --- rules, parents, graph, fusion -----------------------------------------------------------------------------------

def _met(queries: DataFrame, words: DataFrame, text: str) -> DataFrame:
    """(query_id as string, keyword): the words that a query's lower-cased text holds."""
    told = queries.select(F.col("query_id").cast("string").alias("uid"), F.col(text).alias("content"))
    return keyword_counts(told, words).select(F.col("uid").alias("query_id"), "keyword").distinct()


def forced_hits(queries: DataFrame, rules: DataFrame, chunks: DataFrame, text: str = "text") -> DataFrame:
    """Hits that rules (rule_id, all_of array<array<string>>, none_of array<string>, uids) force: each group of all_of
    must have a word in the query, none of none_of may occur. uids are fetched exactly, else by ``uid_`` prefix.

    Words of all rules go through a query once; what they meet is joined by equality, whatever the number of rules.
    """
    kind, rules = dict(queries.dtypes)["query_id"], rules.filter(~F.exists("none_of", lambda w: w == ""))
    groups = F.filter("all_of", lambda g: ~F.array_contains(g, ""))  # an empty word is in every text
    wanted = rules.select("rule_id", F.size(groups).alias("n"), F.posexplode(groups).alias("group", "words")).select("rule_id", "n", "group", F.explode("words").alias("keyword"))
    barred = rules.select("rule_id", F.explode("none_of").alias("keyword"))
    met = _met(queries, wanted.select("keyword").union(barred.select("keyword")), text)
    fired = met.join(wanted, "keyword").groupBy("query_id", "rule_id").agg(F.count_distinct("group").alias("g"), F.any_value("n").alias("n")).filter("g = n").select("query_id", "rule_id")
    free = rules.filter(F.size(groups) == 0).select("rule_id")
    fired = fired.union(queries.select(F.col("query_id").cast("string"), F.lit(1).alias("_k")).join(free.withColumn("_k", F.lit(1)), "_k").select("query_id", "rule_id"))  # all queries, by the rule's meaning
    fired = fired.join(met.join(barred, "keyword").select("query_id", "rule_id"), ["query_id", "rule_id"], "left_anti")
    fired = fired.join(rules.select("rule_id", "uids"), "rule_id").select(F.col("query_id").cast(kind).alias("query_id"), F.explode("uids").alias("uid"))
    found = graph.fetch(fired.select("uid"), chunks.select(F.col("uid").alias("chunk_uid")))
    return fired.join(found, "uid").select("query_id", F.col("chunk_uid").alias("uid"), F.lit(FORCED).alias("similarity"), F.lit("rule").alias("origin")).distinct()


def parent_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Parents (parent_chunk_uid) of hits that are no hits yet."""
    parents = hits.join(chunks.select(F.col("chunk_uid").alias("uid"), "parent_chunk_uid"), "uid").filter(F.col("parent_chunk_uid").isNotNull()).select("query_id", F.col("parent_chunk_uid").alias("uid")).distinct()
    there = parents.join(chunks.select(F.col("chunk_uid").alias("uid")).distinct(), "uid", "left_semi").join(hits.select("query_id", "uid"), ["query_id", "uid"], "left_anti")
    return there.select("query_id", "uid", F.lit(PARENT).alias("similarity"), F.lit("parent").alias("origin"))


def expand_by_graph(hits: DataFrame, edges: DataFrame, cap: int = 5, n: int = 5) -> DataFrame:
    found = graph.votes(edges, hits, cap, n)
    return found.select("query_id", "uid", F.lit(GRAPH).alias("similarity"), F.lit("graph").alias("origin"))


def keyword_k(k: int) -> int:
    """How many keyword hits take part when ``k`` are wanted."""
    return min(k + 8, 25)


def hybrid_steps(vector: DataFrame, keyword: DataFrame | None = None, forced: DataFrame | None = None, chunks: DataFrame | None = None, edges: DataFrame | None = None, k: int = 10) -> tuple[DataFrame, DataFrame | None]:
    """Hits up to the parents, and those that the graph adds (None without edges); see hybrid."""
    names = ["query_id", "uid", "similarity", "origin"]
    first = top(best_per_uid(vector).withColumn("origin", F.lit("vector")), k).select(*names, F.lit(1).alias("step"))
    for step, (more, origin) in enumerate(((keyword, "keyword"), (forced, "rule")), 2):
        if more is not None:
            first = first.unionByName(more.select("query_id", "uid", "similarity", F.lit(origin).alias("origin"), F.lit(step).alias("step")))
    # The earliest step gives a hit its similarity; what a rule forces is raised to the rule's.
    found = first.groupBy("query_id", "uid").agg(F.min_by(F.struct("similarity", "origin"), "step").alias("_f"), F.max(F.when(F.col("step") == 3, F.col("similarity"))).alias("_s"))
    hits = found.select("query_id", "uid", F.greatest("_f.similarity", "_s").alias("similarity"), "_f.origin")
    hits = written(hits, "hits")  # a few rows a query, read by each later step
    if chunks is not None and "parent_chunk_uid" in chunks.columns:
        hits = hits.unionByName(parent_hits(hits, chunks))
    if edges is None:
        return hits, None
    near = expand_by_graph(hits.select("query_id", "uid"), edges)
    if chunks is not None:
        near = near.join(chunks.select(F.col("chunk_uid").alias("uid")).distinct(), "uid", "left_semi").select(*names)
    return hits, near


def hybrid(vector: DataFrame, keyword: DataFrame | None = None, forced: DataFrame | None = None, chunks: DataFrame | None = None, edges: DataFrame | None = None, k: int = 10) -> DataFrame:
    """Fusion: vector hits cut to k, unseen keyword hits, forced hits raised, then parents and graph neighbours of all of
    these that are chunks, best k at the end. Leave a part out to skip its step."""
    hits, near = hybrid_steps(vector, keyword, forced, chunks, edges, k)
    return top(hits if near is None else hits.unionByName(near), k)


def route(queries: DataFrame, hits: DataFrame, trees: DataFrame) -> DataFrame:
    """(query_id, route): a tree's result, its pending question, a live lookup if nothing good was found, else rag.

    trees: (query_id, node_type) of the queries that reached a decision tree.
    """
    best = hits.groupBy("query_id").agg(F.max("similarity").alias("best"))
    rows = queries.select("query_id").join(best, "query_id", "left").join(trees.select("query_id", "node_type"), "query_id", "left")
    way = F.when(F.col("node_type") == "result", "tree").when(F.col("node_type") == "decision", "tree_pending").when(F.col("best").isNull() | (F.col("best") < THRESHOLD), "live_lookup").otherwise("rag")
    return rows.select("query_id", way.alias("route"))


# --- context ---------------------------------------------------------------------------------------------------------

NO_HITS = "No relevant sources were found."


def context_headers(hits: DataFrame, chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """Hits in order with their mark: [i] | LEY or TIPO | ARTICULO or SECCION | ARCHIVO | RELEVANCIA."""
    rows = hits.join(chunks, "uid").join(titles, "law_tag", "left")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "uid"))
    article = F.translate(F.regexp_extract("uid", r"_art_(.+)$", 1), "_-", "  ")
    kind = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("LEY: "), "title")).when(F.coalesce("source_type", F.lit("")) != "", F.concat(F.lit("TIPO: "), F.initcap(F.translate("source_type", "_", " "))))
    place = F.when(article != "", F.concat(F.lit("ARTÍCULO: Art. "), article)).when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit("SECCIÓN: "), "section"))
    file = F.when(F.coalesce("filename", F.lit("")) != "", F.concat(F.lit("ARCHIVO: "), "filename"))
    rows = rows.withColumn("i", rank)
    return rows.withColumn("header", F.concat_ws(" | ", F.concat(F.lit("["), F.col("i").cast("string"), F.lit("]")), kind, place, file, F.format_string("RELEVANCIA: %.2f", F.col("similarity"))))


def notes_for(queries: DataFrame, notes: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, notes): texts of the notes (note_id, any_of, note) with a trigger in the query, in order. Triggers of all
    notes go through a query once."""
    kind, triggers = dict(queries.dtypes)["query_id"], notes.select("note_id", "note", F.explode("any_of").alias("keyword"))
    found = _met(queries, triggers.select("keyword"), text).join(triggers, "keyword").select("query_id", "note_id", "note").distinct()
    out = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("note_id", "note"))).alias("_n"))
    return out.select(F.col("query_id").cast(kind).alias("query_id"), F.transform("_n", lambda n: n["note"]).alias("notes"))


def build_context(queries: DataFrame, headed: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """(query_id, context): notes, then one block a hit in order; a fixed text if a query has no hits.

    Where the hits have a map ``metadata``, a block ends in a line of its date, instance and document, as far as there.
    A query holds as many blocks as the search's k, so collecting them is bounded.
    """
    content = F.regexp_replace(F.regexp_replace("content", r"^[ \t\n\r]+|[ \t\n\r]+$", ""), r"\n{3,}", "\n\n")
    block = F.concat(F.col("header"), F.lit("\n" + "-" * 60 + "\n"), content, F.lit("\n"))
    if "metadata" in headed.columns:
        told = lambda key, label: F.when((F.coalesce(F.col("metadata")[key], F.lit("")) != "") & ((F.col("metadata")[key] != "N/A") | F.lit(key != "pdf_url")), F.concat(F.lit(f"{label}: "), F.col("metadata")[key]))
        line = F.concat_ws(" | ", told("fecha", "Fecha"), told("instancia", "Instancia"), told("pdf_url", "PDF"))
        block = F.concat(block, F.when(line != "", F.concat(F.lit("  → "), line, F.lit("\n"))).otherwise(""))
    blocks = headed.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("i", block.alias("b")))).alias("_b"))
    rows = queries.select("query_id").join(blocks, "query_id", "left")
    lead = F.lit("")
    if notes is not None:
        rows = rows.join(notes, "query_id", "left")
        lead = F.when(F.size("notes") > 0, F.concat(F.array_join(F.transform("notes", lambda n: F.concat(F.lit("• "), n)), "\n"), F.lit("\n\n"))).otherwise("")
    return rows.select("query_id", F.when(F.col("_b").isNull(), NO_HITS).otherwise(F.concat(lead, F.array_join(F.transform("_b", lambda b: b["b"]), "\n"))).alias("context"))
