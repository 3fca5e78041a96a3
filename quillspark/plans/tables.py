"""The engine's tables, bound to the driver's: each as a DataFrame and as SQL for a common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spread import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str, flags: bool = False) -> DataFrame:
    """Documents as chunks: language for the law, source for the kind, every fourth one public; with ``flags``, toxic ones
    are derogated."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    org = F.when(F.col("doc_id") % 4 != 0, (F.col("doc_id") % 4).cast("string"))
    columns = [
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("chunk_uid"), F.col("doc_id"), F.col("text").alias("content"),
        F.col("lang").alias("law_tag"), F.col("source").alias("source_type"), F.sha2("text", 256).alias("content_hash"),
    ]
    if flags:
        docs = docs.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
        columns.append((F.coalesce("toxic", F.lit(0)) == 1).alias("is_derogada"))
    return docs.select(*columns, org.alias("organization_id"))


CHUNKS = """chunks AS (
  SELECT 'doc_' || d.doc_id AS chunk_uid, d.doc_id, d.text AS content, d.lang AS law_tag, d.source AS source_type, sha256(d.text) AS content_hash,
         coalesce(l.toxic, 0) = 1 AS is_derogada, CASE WHEN d.doc_id % 4 <> 0 THEN (d.doc_id % 4)::VARCHAR END AS organization_id
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and their suppliers as a directed graph, typed by return flag."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey", "l_returnflag").agg(F.max("l_discount").alias("confidence"))
    return lines.select(F.concat(F.lit("p_"), "l_partkey").alias("source_chunk_uid"), F.concat(F.lit("s_"), "l_suppkey").alias("target_chunk_uid"), F.col("l_returnflag").alias("relation_type"), "confidence")


EDGES = """edges AS (
  SELECT 'p_' || l_partkey AS source_chunk_uid, 's_' || l_suppkey AS target_chunk_uid, l_returnflag AS relation_type, max(l_discount) AS confidence
  FROM lineitem GROUP BY ALL)"""


def law_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as chunks of articles: the order is the article, its customer's nation the law."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = lines.count()  # from the files' footers
    orders = dealt(dealt(orders, n, "o_custkey").join(customers, "o_custkey"), n, "l_orderkey")  # before they meet the lines, which are more
    rows = dealt(lines, n, "l_orderkey").join(orders, "l_orderkey")
    law = F.concat(F.lit("law"), F.col("c_nationkey"))
    uid = F.concat_ws("_", F.lit("ley"), law, F.lit("art"), F.col("l_orderkey"), F.col("l_linenumber"))
    return rows.select(uid.alias("chunk_uid"), law.alias("law_tag"), F.col("l_orderkey").alias("num"), F.col("l_linenumber").alias("chunk_index"))


LAW_CHUNKS = """law_chunks AS (
  SELECT 'ley_law' || c_nationkey || '_art_' || l_orderkey || '_' || l_linenumber AS chunk_uid, 'law' || c_nationkey AS law_tag, l_orderkey AS num, l_linenumber AS chunk_index
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)"""


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("chat_id"), F.col("event_type").alias("query_type"), F.col("props").alias("query_text"), F.col("ts").alias("created_at"), "value")
