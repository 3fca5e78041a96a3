"""The stored keyword index gives the rows of the full search and reads few texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import keyword_index, retrieval
from quillspark.plans import search
from quillspark.sources.scratch import scratch
from tests.conftest import SF


def rows(df):
    return sorted((r.query_id, r.uid, r.similarity) for r in df.collect())


@pytest.mark.parametrize("scale,block", [("0.01", 4), ("0.1", 64)])
def test_same_hits_and_few_texts(spark, monkeypatch, scale, block):
    monkeypatch.setattr(keyword_index, "BLOCK", block)
    d = SF.replace("0.001", scale)
    path, queries, texts = scratch(spark, "keywords"), search._items(spark, d), search._texts(spark, d)
    keyword_index.build_keyword_index(texts, path, header="header")
    laws = queries.select("query_id", F.lit("en").alias("law_tag"))
    cited = queries.select("query_id", F.concat(F.lit("_"), "query_id").alias("article"))
    keywords = search._keywords(spark, d)
    for articles in (None, cited):  # the second search finds the index as it is
        counts = {}
        got = rows(keyword_index.indexed_search(spark, path, keywords, 10, articles, laws, counts))
        assert got == rows(retrieval.keyword_search(texts, keywords, 10, articles, laws, header="header"))
        assert counts["texts"] == texts.count()
        if scale == "0.1":
            assert counts["compared"] < 0.2  # of all pairs of a query and a text
    if scale == "0.1":  # one query by itself
        counts, one = {}, keywords.filter("keyword = 'the'").agg(F.min("query_id")).first()[0]
        keyword_index.indexed_search(spark, path, keywords.filter(F.col("query_id") == one), 10, None, laws, counts)
        assert counts["read"] < 0.2 * counts["texts"]


def test_edges(spark):
    path = scratch(spark, "keywords")
    chunks = spark.createDataFrame([("a", "x", "Alpha beta", "h_1"), ("b", None, None, None), (None, "x", "alpha", ""), ("c", "y", "ab alphabet", ""), ("c", "y", "ab alphabet", "")], "uid string, law_tag string, content string, header string")
    keyword_index.build_keyword_index(chunks, path, header="header")
    keywords = spark.createDataFrame([(1, "alpha"), (1, ""), (2, "ab"), (3, "missing"), (4, "h_1")], "query_id long, keyword string")
    articles = spark.createDataFrame([(1, "_1"), (2, "")], "query_id long, article string")
    laws = spark.createDataFrame([(1, "x"), (2, "y")], "query_id long, law_tag string")
    full = chunks.filter("uid is not null")
    for k in (1, 5):
        got = rows(keyword_index.indexed_search(spark, path, keywords, k, articles, laws))
        assert got == rows(retrieval.keyword_search(full, keywords, k, articles, laws, header="header"))
    assert keyword_index.indexed_search(spark, path, keywords.limit(0)).count() == 0


def test_bounds_hold():
    texts = [("u1", "l", "the thesis of the theme " * 3, "the"), ("u2", "m", "nothing", ""), ("u3", "l", "", None)]
    _, _, _, laws, names, grams, density, *_ = keyword_index._block(0, texts)
    queries = [(1, ["the", "thes"], ["u3"], {"l"}), (2, ["nothing", "zzz"], [], set()), (3, ["zzz"], [], {"m"})]
    score, article, law = keyword_index._Bounds(queries).of(laws, names, grams, density)
    scorer = retrieval.Scorer(queries)
    for uid, tag, body, head in texts:
        found = scorer.score(uid, tag, body, head)
        for q, s, a, w in zip(*found) if found else []:
            assert s <= score[q] and a <= article[q] and w <= law[q]
    assert score[2] == -1 and article.tolist() == [True, False, False]
    assert len(keyword_index.word_grams("ab")) == 0 and len(np.unique(keyword_index.word_grams("aaaaaaa"))) == 1
    assert set(keyword_index.word_grams("hes")) <= set(keyword_index.text_grams("thesis")) >= set(keyword_index.word_grams("thesis"))
