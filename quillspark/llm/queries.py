"""Thin queries over the driver's tables: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .embedding_dedup import embedding_groups
from .exact_dedup import exact_groups
from .language_id import identify_language, train_language_id
from .lm_score import score_texts
from .mixing import mix_sources, word_count
from .near_dedup import near_groups
from .packing import pack
from .prefix_trie import prefix_trie
from .quality_rules import judge_quality
from .substring_dedup import repeated_spans
from .toxicity import score_toxicity, train_toxicity
from .url_filter import url_filter
from .whitening import whiten

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def fold(n: int) -> Column:
    """Remainder of crc32 of the id as text."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(docs, _table(spark, sf_dir, "labels"), fold(5) != 0)
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train_language_id(docs.select("doc_id", "text", "lang"), fold(4) != 2)
    judged = identify_language(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1], ends[1:])]
        names = [n for n in batch.schema.names if n != "ids"]
        yield pa.record_batch([*(batch.column(n) for n in names), pa.array(crc, pa.int64())], names=[*names, "ids_crc32"])


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long"
    return pieces.mapInArrow(_id_digests, schema).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), fold(5) != 1)
    return scored.select("doc_id", (fold(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    mix = mix_sources(docs, size=F.col("words"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(_table(spark, sf_dir, "documents")).drop("lang")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_near_dedup": op5_near_dedup,
    "op6_packing": op6_packing,
    "op7_lm_score": op7_lm_score,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_mixing": op9_mixing,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_quality_rules": op11_quality_rules,
    "op12_whitening": op12_whitening,
    "op13_prefix_trie": op13_prefix_trie,
}
