"""Sinks: partition replacement, logs, markdown export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_partitions(chunks: DataFrame, path: str, *by: str) -> None:
    """Replace exactly the partitions (for instance of one law) that ``chunks`` holds."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def log_rows(queries: DataFrame, text: str = "query_text", limit: int = 2000) -> DataFrame:
    """Log rows: type chat, text cut to ``limit`` characters."""
    return queries.select(*(c for c in queries.columns if c not in (text, "query_type")), F.lit("chat").alias("query_type"), F.substring(text, 1, limit).alias(text))


def markdown_document(title: Column, date: Column, body: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n\n_"), date, F.lit("_\n\n---\n\n"), body)


def export_markdown(docs: DataFrame, path: str, slug: str, markdown: str) -> None:
    """One folder of text files per slug."""
    docs.select(F.col(slug), F.col(markdown)).write.mode("overwrite").partitionBy(slug).text(path)
