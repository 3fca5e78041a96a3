"""Readers and record builders: markdown records, law pages, index pages, ruling JSON, decision trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .files import parted, read_files

RULING = "id string, codigo string, fecha string, tipoPronunciamiento struct<nombre:string>, instancia struct<nombre:string>, texto string, resumen string, urlDocumento string, articuloId string"
NODE = "struct<id:string,type:string,question:string,help:string,legal_ref:string,summary:string,details:string,warnings:array<string>,next_steps:array<string>,branches:array<struct<condition:string,next_node:string>>,next_node:string,legal_refs:array<string>>"
TREE = f"tree_id string, title string, law string, article string, description string, tags array<string>, root {NODE}, nodes map<string,{NODE}>"
TREE_KEYS = "tree_id,title,law,article,description,root"


def read_markdown(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Whole files below ``path`` whose names match, one record each: path, content."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_rulings(spark: SparkSession, path: str) -> DataFrame:
    return read_markdown(spark, path, "sii_pron_*.md")


def read_circulars(spark: SparkSession, path: str) -> DataFrame:
    return read_markdown(spark, path, "sii_circular_*.md")


def markdown_records(files: DataFrame, prefix: str, number: str, laws: Sequence[tuple[str, Sequence[str]]] = (), default_law: str = "ley") -> DataFrame:
    """Files (path, content) as chunk rows; those without a filled section are dropped.

    The uid is ``prefix`` and the record's id, else what the pattern ``number`` finds in the file's name, else the name's
    stem. The law is named by the code in the metadata or, failing that, by the first of ``laws`` with a word of its in the
    content.
    """
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(F.col("path").alias("source_path"), name.alias("filename"), T.metadata_map(F.col("content")).alias("metadata"), T.record_text(F.col("content")).alias("content")).filter("content is not null")
    filled = lambda c: F.when(c != "", c)
    ident = F.coalesce(filled(F.col("metadata")["jurisprudencia_id"]), filled(F.col("metadata")["id"]), filled(F.regexp_extract("filename", number, 1)), F.regexp_replace("filename", r"\.[^.]*$", ""))
    law = F.coalesce(filled(F.col("metadata")["law_tag"]), T.first_match(F.col("content"), laws, default_law))
    article = filled(F.col("metadata")["articulo_nombre"])
    rows = rows.withColumns({"chunk_uid": F.concat(F.lit(prefix), ident), "law_tag": law, "content_hash": F.sha2("content", 256)})
    return rows.select(
        "chunk_uid", "source_path", "filename", "law_tag", F.concat_ws("/art_", "law_tag", article).alias("hierarchy_path"), "content", "content_hash",
        F.coalesce(F.lower(F.col("metadata")["estado"]).isin("derogada", "revocada"), F.lit(False)).alias("is_derogada"), "metadata",
    )


def read_trees(spark: SparkSession, path: str, drafts: bool = False) -> tuple[DataFrame, DataFrame]:
    """Decision trees below ``path``: (good ones, rejected ones with path). Drafts, in folders named _drafts, by option."""
    raw = spark.read.schema(f"{TREE}, _corrupt_record string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("path"))
    if not drafts:
        raw = raw.filter(~F.contains("path", F.lit("/_drafts/")))
    whole = F.col("tree_id").isNotNull() & F.col("title").isNotNull() & F.col("root.id").isNotNull() & F.col("_corrupt_record").isNull()
    return raw.filter(whole).drop("_corrupt_record"), raw.filter(~whole).select("path", "tree_id")


def read_tree_files(spark: SparkSession, path: str, drafts: bool = False) -> tuple[DataFrame, DataFrame]:
    """Decision trees below ``path``, one a file: (trees, rejected files with content and reason).

    A file is rejected if it is no JSON object, lacks one of ``TREE_KEYS`` or has a root that is no object. Of files with
    one tree_id the last in the order of their paths, folder by folder, counts. Drafts, in folders named _drafts, by option.
    """
    files = read_files(spark, path, "*.json", format="json", required=TREE_KEYS, skip="" if drafts else "_drafts")
    parsed = files.withColumn("t", F.when(F.col("reason").isNull(), F.from_json("content", TREE)))
    odd = F.when(F.col("t.tree_id").isNull() | F.col("t.root").isNull(), "not a tree")
    good, rejected = parted(parsed.withColumn("reason", F.coalesce("reason", odd)))
    last = good.groupBy(F.col("t.tree_id").alias("_id")).agg(F.max_by("t", F.split("path", "/")).alias("t"))
    return last.select("t.*"), rejected.drop("t")


def pages_to_text(pages: DataFrame, path: str, number: str, text: str) -> DataFrame:
    """(path, pages_text, pages): pages in order, empty ones skipped, a newline after each."""
    full = pages.filter(F.col(text).isNotNull() & (F.col(text) != ""))
    grouped = full.groupBy(path).agg(F.sort_array(F.collect_list(F.struct(F.col(number), F.col(text)))).alias("_pages"))
    joined = F.array_join(F.transform("_pages", lambda p: F.concat(p[text], F.lit("\n"))), "")
    return grouped.select(path, joined.alias("pages_text"), F.size("_pages").cast("long").alias("pages"))


def named_like(files: DataFrame, name: str, keywords: Sequence[str]) -> DataFrame:
    """Files whose lower-case name holds one of the keywords."""
    return files.filter(F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower(name), k)))


def index_links(pages: DataFrame, pattern: str, html: str = "html") -> DataFrame:
    """One row per match of ``pattern`` in a page, with its two groups as target and title."""
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), 1).alias("target"), F.regexp_extract_all(html, F.lit(pattern), 2).alias("title"))
    return pages.select(*(c for c in pages.columns if c != html), F.explode(pairs).alias("_m")).select("*", "_m.target", "_m.title").drop("_m")


def linked_years(pages: DataFrame, html: str, pattern: str, since: int, until: int) -> DataFrame:
    """Distinct years named in a page, or all of the range if it names none."""
    years = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(pattern), 1), lambda y: y.cast("int"))))
    every = F.sequence(F.lit(since), F.lit(until))
    return pages.select("*", F.explode(F.when(F.size(years) > 0, years).otherwise(every)).alias("year"))


def markdown_layout(meta: Sequence[tuple[str, Column]], summary: Column, body: Column) -> Column:
    """The record layout: a metadata list, a summary and a body; what is empty becomes a full stop."""
    dot = lambda c: F.when(F.coalesce(c, F.lit("")) == "", ".").otherwise(c)
    lines = F.concat_ws("\n", F.lit("## Metadata"), *(F.concat(F.lit(f"- {k}: "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in meta))
    return F.concat_ws("\n\n", lines, F.concat(F.lit("## Resumen\n"), dot(summary)), F.concat(F.lit("## Contenido\n"), dot(body)))


def ruling_records(rows: DataFrame, json: str) -> DataFrame:
    """Ruling JSON as flat records and in the markdown layout; dates that can't be read stay text."""
    r = rows.withColumn("_r", F.from_json(json, RULING))
    day = F.coalesce(F.date_format(F.try_to_timestamp("_r.fecha"), "yyyy-MM-dd"), F.col("_r.fecha"))
    url = F.when(F.coalesce(F.col("_r.urlDocumento"), F.lit("")) == "", "N/A").otherwise(F.col("_r.urlDocumento"))
    dot = lambda c: F.when(F.coalesce(c, F.lit("")) == "", ".").otherwise(c)
    meta = [("id", F.col("_r.id")), ("fecha", day), ("tipo", F.col("_r.tipoPronunciamiento.nombre")), ("pdf_url", url)]
    return r.select(
        *rows.columns, F.col("_r.id").alias("id"), F.col("_r.tipoPronunciamiento.nombre").alias("kind"), F.col("_r.instancia.nombre").alias("instance"), day.alias("date"),
        dot(F.col("_r.resumen")).alias("summary"), dot(F.col("_r.texto")).alias("body"), url.alias("url"), markdown_layout(meta, F.col("_r.resumen"), F.col("_r.texto")).alias("markdown"),
    )
