"""Audits of corpus and graph, and retrieval quality."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import in_order


def gaps(numbers: DataFrame, wider_than: int = 5, first: int = 5) -> DataFrame:
    """Per law the first gaps between consecutive article numbers: (law_tag, num, next_num, missing)."""
    rows = in_order(numbers.select("law_tag", "num").distinct(), ["law_tag"], ["num"], {"next_num": "num"})
    by = Window.partitionBy("law_tag").orderBy("num")  # Spark keeps the first few of each task before it deals them
    rows = rows.filter(F.col("next_num") - F.col("num") > wider_than).withColumn("_n", F.row_number().over(by))
    return rows.filter(F.col("_n") <= first).select("law_tag", "num", "next_num", (F.col("next_num") - F.col("num") - 1).alias("missing"))


def coverage(expected: DataFrame, present: DataFrame) -> DataFrame:
    """(law_tag, num, status): missing or extra article numbers, from two tables of (law_tag, num)."""
    side = lambda df, bit: df.select("law_tag", "num", F.lit(bit).alias("_side"))
    met = side(expected, 1).unionByName(side(present, 2)).groupBy("law_tag", "num").agg(F.bit_or("_side").alias("_side"))  # one table of groups a task, not six
    return met.filter("_side <> 3").select("law_tag", "num", F.when(F.col("_side") == 1, "missing").otherwise("extra").alias("status"))


def split_articles(chunks: DataFrame, more_than: int = 2) -> DataFrame:
    """Articles in more chunks than that, with their uids in order."""
    grouped = chunks.groupBy("law_tag", "num").agg(F.count(F.lit(1)).alias("chunks"), F.array_join(F.sort_array(F.collect_list("chunk_uid")), ",").alias("uids"))
    return grouped.filter(F.col("chunks") > more_than)


def flags(chunks: DataFrame, short: int = 500, long: int = 6000) -> DataFrame:
    """Per chunk: bad characters, bad beginnings and ends, length class, first and last 100 characters."""
    text = F.regexp_replace("content", r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    return chunks.select(
        "chunk_uid",
        (F.length("content") - F.length(F.replace("content", F.lit("�"), F.lit("")))).alias("bad_chars"),
        text.rlike(r"^[a-záéíóúñ]").alias("starts_mid_word"),
        text.rlike(r"[a-záéíóúñ]$").alias("ends_mid_word"),
        (~text.rlike(r"[.;:!?)]$")).alias("ends_mid_sentence"),
        F.when(F.length("content") < short, "short").when(F.length("content") > long, "long").otherwise("normal").alias("length_class"),
        F.substring("content", 1, 100).alias("first_100"),
        F.right("content", F.lit(100)).alias("last_100"),
    )


def final_flags(chunks: DataFrame, short: int = 200, long: int = 4000) -> DataFrame:
    text = F.regexp_replace("content", r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    return chunks.select("chunk_uid", (F.length("content") < short).alias("too_short"), (F.length("content") > long).alias("too_long"), text.rlike(r"^[a-záéíóúñ]").alias("bad_start"), (~text.rlike(r"[.;:!?)]$")).alias("bad_end"))


def summary(flagged: DataFrame, edges: DataFrame, broken_edges: DataFrame) -> DataFrame:
    """One row: chunks, those with severe and mild problems, edges, broken edges and a verdict."""
    severe, mild = F.col("too_short") | F.col("bad_start"), F.col("too_long") | F.col("bad_end")
    counts = flagged.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(severe).alias("severe"), F.count_if(mild & ~severe).alias("mild")).withColumn("_k", F.lit(1))
    sizes = edges.agg(F.count(F.lit(1)).alias("edges")).withColumn("_k", F.lit(1))
    bad = broken_edges.agg(F.count(F.lit(1)).alias("broken")).withColumn("_k", F.lit(1))
    verdict = F.when((F.col("severe") == 0) & (F.col("broken") == 0), "ok").when(F.col("severe") * 20 <= F.col("chunks"), "review").otherwise("fail")
    return counts.join(sizes, "_k").join(bad, "_k").drop("_k").withColumn("verdict", verdict)


def must_exist(articles: DataFrame, chunks: DataFrame) -> DataFrame:
    """Required (law_tag, article) that no chunk's article key equals or continues after an underscore."""
    parts = F.split("article", "_")
    keys = chunks.select("law_tag", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "_"))).alias("article")).distinct()
    return articles.join(keys, ["law_tag", "article"], "left_anti")


def critical(checks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_uid, status, absent) for checks (chunk_uid, keywords): which keywords a chunk lacks."""
    rows = checks.join(chunks.select("chunk_uid", F.lower("content").alias("_text")), "chunk_uid", "left")
    absent = F.filter("keywords", lambda k: ~F.contains(F.col("_text"), F.lower(k)))
    status = F.when(F.col("_text").isNull(), "absent chunk").when(F.size(absent) > 0, "incomplete").otherwise("ok")
    return rows.select("chunk_uid", status.alias("status"), F.when(F.col("_text").isNull(), F.array_join("keywords", ",")).otherwise(F.array_join(absent, ",")).alias("absent"))


def quality(cases: DataFrame) -> DataFrame:
    """(case_id, passed) for cases (case_id, expected_uids, expected_strings, hit_uids, context)."""
    uids = F.forall("expected_uids", lambda e: F.exists("hit_uids", lambda h: F.contains(h, e)))
    strings: Column = F.forall("expected_strings", lambda e: F.contains("context", e))
    return cases.select("case_id", (uids & strings).alias("passed"))


def lift(base: DataFrame, expanded: DataFrame) -> DataFrame:
    """(query_id, base_hits, added): how many uids an expansion adds to a query's base hits."""
    added = expanded.select("query_id", "uid").distinct().join(base.select("query_id", "uid").distinct(), ["query_id", "uid"], "left_anti").groupBy("query_id").agg(F.count(F.lit(1)).alias("added"))
    hits = base.groupBy("query_id").agg(F.count_distinct("uid").alias("base_hits"))
    return hits.join(added, "query_id", "full").select("query_id", F.coalesce("base_hits", F.lit(0)).alias("base_hits"), F.coalesce("added", F.lit(0)).alias("added"))


def total(rows: DataFrame, name: str = "rows") -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias(name))


def per_value(rows: DataFrame, column: str, name: str = "rows", only: Sequence[str] = ()) -> DataFrame:
    """Rows of each value of a column, or of the values asked for."""
    rows = rows.filter(F.col(column).isin(*only)) if only else rows
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def union_totals(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, rows_in): rows of several tables, each under its name."""
    kinds = [t.select(F.lit(name).alias("kind")) for name, t in tables.items()]
    return per_value(reduce(DataFrame.unionByName, kinds), "kind", "rows_in")


def length_lists(chunks: DataFrame, shortest: int, longest: int) -> DataFrame:
    """(list, chunk_uid, chars): the shortest and the longest chunks."""
    c = chunks.select("chunk_uid", F.length("content").cast("long").alias("chars"))
    low = c.orderBy("chars", "chunk_uid").limit(shortest).select(F.lit("shortest").alias("list"), "chunk_uid", "chars")
    return low.union(c.orderBy(F.desc("chars"), "chunk_uid").limit(longest).select(F.lit("longest"), "chunk_uid", "chars"))
