"""Chunk and edge stores: filters, upserts, replacement, deduplication, ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from .versioned import first_of


def visible(chunks: DataFrame, source_types: Sequence[str] | None = None, law_tags: Sequence[str] | None = None, include_derogated: bool = False, organization: str | None = None, all_tenants: bool = False) -> DataFrame:
    """Optional value filters, validity and tenant visibility. Without an organisation only public rows are seen."""
    if source_types:
        chunks = chunks.filter(F.col("source_type").isin(*source_types))
    if law_tags:
        chunks = chunks.filter(F.col("law_tag").isin(*law_tags))
    if not include_derogated:
        chunks = chunks.filter(~F.col("is_derogada"))
    if not all_tenants:
        public = F.col("organization_id").isNull()
        chunks = chunks.filter(public if organization is None else public | (F.col("organization_id") == organization))
    return chunks


def new_rows(incoming: DataFrame, stored: DataFrame, key: str = "content_hash") -> DataFrame:
    """Rows whose content is not stored yet."""
    return incoming.join(stored.select(key).distinct(), key, "left_anti")


def first_per(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row per key; ordering must be total for a repeatable result."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def mark_duplicates(df: DataFrame, uid: str, *order: Column) -> DataFrame:
    """Repeated uids get _dup2, _dup3 ... in order; the first stays as it is."""
    n = F.row_number().over(Window.partitionBy(uid).orderBy(*order))
    return df.withColumn(uid, F.when(n > 1, F.concat(F.col(uid), F.lit("_dup"), n.cast("string"))).otherwise(F.col(uid)))


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "chunk_uid", order: Sequence[Column | str] = (), dimension: tuple[str, int] | None = None) -> DataFrame:
    """A new snapshot: incoming rows replace stored ones of the same key. Columns as in ``stored``.

    Of several incoming rows of a key the first by ``order`` is taken; with ``dimension``, a column of vectors and their
    length, rows of another length are refused before that.
    """
    if dimension:
        incoming = incoming.filter(vectors.has_dimension(*dimension))
    new = first_of(incoming, key, *order)
    return stored.join(new.select(key), key, "left_anti").unionByName(new.select(*stored.columns))


def without(stored: DataFrame, uids: DataFrame, key: str = "chunk_uid") -> DataFrame:
    return stored.join(uids.select(key).distinct(), key, "left_anti")


def append_edges(stored: DataFrame, incoming: DataFrame, *order: Column | str) -> DataFrame:
    """Incoming edges that are new by (source, target, type), one of each: the first by ``order``; without an order, which
    rows of a table don't have by themselves, the one of highest confidence."""
    triple = ["source_chunk_uid", "target_chunk_uid", "relation_type"]
    fresh = incoming.groupBy(*triple).agg((F.min_by("confidence", F.struct(*order, -F.col("confidence"))) if order else F.max("confidence")).alias("confidence"))
    return fresh.join(stored.select(*triple).distinct(), triple, "left_anti")


def latest(df: DataFrame, keys: Sequence[str], columns: Sequence[str], *by: str) -> DataFrame:
    """Last write wins: the columns of the row with the greatest ``by`` per key; combines before it shuffles."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*by)).alias("_last")).select(*keys, "_last.*")


def synced(items: DataFrame, state: DataFrame, skip_articles: bool = False, full: bool = False) -> DataFrame:
    """Items still to fetch: those whose key is not in the state, or, by option, whose whole article is not."""
    if full:
        return items
    if skip_articles:
        items = items.join(state.select("article_id").distinct(), "article_id", "left_anti")
    return items.join(state.select("article_id", "item_id").distinct(), ["article_id", "item_id"], "left_anti")


def upload_outcomes(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """(target, uploaded, skipped): a file is skipped if its target and first 16 digits of sha256 are in the ledger."""
    keyed = files.withColumn("digest", F.substring(F.sha2("content", 256), 1, 16))
    known = ledger.select("target", "digest").distinct().withColumn("_known", F.lit(1))
    return keyed.join(known, ["target", "digest"], "left").groupBy("target").agg(F.count_if(F.col("_known").isNull()).alias("uploaded"), F.count_if(F.col("_known").isNotNull()).alias("skipped"))


def nonempty(column: str) -> Column:
    """Neither null nor empty."""
    return F.col(column).isNotNull() & (F.col(column) != "")


def any_keyword(column: str, words: Sequence[str]) -> Column:
    """Holds one of the words, without regard to case."""
    return F.exists(F.array(*map(F.lit, words)), lambda k: F.contains(F.lower(column), F.lower(k)))


def long_enough(rows: DataFrame, column: str, least: int, batch_limit: int) -> DataFrame:
    """Rows whose text has ``least`` characters (``chars``), and how many of all rows stay below ``batch_limit``."""
    measured = rows.withColumn("chars", F.length(column).cast("long"))
    short = measured.agg(F.count_if(F.col("chars") < batch_limit).alias("below_batch_limit")).withColumn("_k", F.lit(1))  # one row
    return measured.filter(F.col("chars") >= least).withColumn("_k", F.lit(1)).join(F.broadcast(short), "_k").drop("_k")


def latest_queries(log: DataFrame, n: int = 50) -> DataFrame:
    """The last ``n`` queries with a text."""
    return log.filter(nonempty("query_text")).orderBy(F.desc("created_at"), F.desc("id")).limit(n)
