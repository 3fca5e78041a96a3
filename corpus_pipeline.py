"""A corpus pipeline of five operators: each stage reads the documents that the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.exact_dedup import exact_dedup
from quillspark.llm.mixing import mix_sources
from quillspark.llm.near_dedup import near_dedup
from quillspark.llm.packing import pack
from quillspark.llm.shared import stored
from quillspark.llm.toxicity import score_toxicity, train_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents with a score of one half or more go; the network learns from all labelled documents.

    Null and empty texts score 0 and stay; repeated rows stay or go together; without labels of both kinds, and in an
    empty table, nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train_toxicity(docs.select("doc_id", "text"), labels, F.lit(True))
    return score_toxicity(docs, model).filter("score < 0.5").drop("score")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the row with the largest doc_id stays.

    Null texts count as empty, so one row of all null and empty texts stays, and one of rows that are alike; an empty
    table stays empty.
    """
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each group linked by similar texts the smallest doc_id stays.

    Null and empty texts and rows without an id stay; rows that share an id stay or go together; an empty table stays
    empty.
    """
    return near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: each row as often as the mix takes it, up to three times.

    A null source is a source of its own; null texts have size 0 and are taken where their place lies inside the mix; an
    empty table stays empty.
    """
    mixed = mix_sources(docs)
    return mixed.filter("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: one row per piece of a document in a training sequence.

    Null and empty texts hold only the end token; rows that the mix repeats are packed each; an empty table gives no rows.
    """
    return pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack_sequences),
]

#: Learning, shingle signatures and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds every stage against plain
#: Python, and run() against its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each on what its predecessor wrote; an empty table of documents passes through."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
