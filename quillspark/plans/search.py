"""Queries of retrieval, guardrail, trees, sources and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.spread import spread
from ..operators import audit, guardrail, keyword_index, retrieval, trees, vector_index
from ..operators.versioned import VersionedTable
from ..sources.files import write_files
from ..sources.scratch import scratch
from ..streaming import streams
from .tables import CHUNKS, EDGES, chunks, edges, table
from .texts import _STRIP, markdown_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- vector search: every vector whose id is divisible by 50 asks, all vectors answer ---------------------------------

_VECTORS = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
s AS (SELECT q.vec_id AS query_id, 'v_' || c.vec_id AS uid, c.label, round(list_dot_product(q.e, c.e) / (q.n * c.n), 6) AS similarity FROM v q JOIN v c ON q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, uid) AS k FROM s)"""


def _asking(spark, d):
    return table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _answering(spark, d):
    return table(spark, d, "embeddings").select(F.concat(F.lit("v_"), "vec_id").alias("uid"), "embedding", F.col("label").cast("string").alias("law_tag"))


@query("r1_match_chunks", f"WITH {_VECTORS} SELECT query_id, uid, similarity FROM r WHERE k <= 10")
def r1(spark, d):
    return retrieval.match_chunks(_asking(spark, d), _answering(spark, d)).select("query_id", "uid", "similarity")


@query("j2_exact_vector_match", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
SELECT q.vec_id AS query_id, 'v_' || c.vec_id AS uid, round(list_dot_product(q.e, c.e) / (q.n * c.n), 6) AS similarity FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.label = q.label QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY similarity DESC, uid) <= 50""")
def j2(spark, d):
    """Exact match inside each label, the filter of the search, k at its greatest."""
    asking = table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").cast("string").alias("law_tag"))
    return retrieval.match_chunks(asking, _answering(spark, d), 50, by=["law_tag"]).select("query_id", "uid", "similarity")


@query("o1_vector_top_k", f"WITH {_VECTORS} SELECT query_id, uid, k AS place FROM r WHERE k <= 5")
def o1(spark, d):
    from pyspark.sql import Window

    hits = retrieval.match_chunks(_asking(spark, d), _answering(spark, d), 5)
    return hits.select("query_id", "uid", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "uid")).cast("long").alias("place"))


@query("r2_inverted_lists")
def r2(spark, d):
    """Four fifths of the vectors are indexed, the rest is added to the stored lists, then the index is searched."""
    path, c = scratch(spark, "index"), _answering(spark, d)
    later = F.pmod(F.crc32("uid"), F.lit(5)) == 0
    vector_index.build_index(c.filter(~later), path)
    vector_index.add_vectors(c, path)
    return vector_index.search_index(_asking(spark, d), path).select("query_id", "uid", "similarity")


# --- keyword search: all benchmark texts ask, all documents answer ---------------------------------------------------

_STOP = ["that", "with", "this", "from", "avec", "pour", "dans"]
_SYN = [("the", ["thea", "thes"]), ("tion", ["tion", "ation"])]
_KEYWORDS = """w AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '([0-9a-z_áéíóúüñàèìòùâêîôûäëïöçß]+)')) AS w FROM (SELECT item_id AS query_id, text FROM benchmark)),
syn(term, expansion) AS (VALUES ('the', ['thea', 'thes']), ('tion', ['tion', 'ation'])),
kw AS (SELECT DISTINCT query_id, unnest(list_append(coalesce(expansion, []::VARCHAR[]), w)) AS keyword FROM w LEFT JOIN syn ON term = w WHERE w NOT IN ('that', 'with', 'this', 'from', 'avec', 'pour', 'dans') AND (length(w) > 3 OR term IS NOT NULL))"""


def _items(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _keywords(spark, d, queries=None):
    queries = _items(spark, d) if queries is None else queries
    stop = spark.createDataFrame([(w,) for w in _STOP], "word string")
    return retrieval.query_keywords(queries, "text", stop, spark.createDataFrame(_SYN, "term string, expansion array<string>"))


def _texts(spark, d):
    return chunks(spark, d).select(F.col("chunk_uid").alias("uid"), "content", "law_tag", "source_type", F.col("source_type").alias("section"), F.concat("chunk_uid", F.lit(".md")).alias("filename"), F.left("content", F.lit(60)).alias("header"))


@query("t26_keywords", f"WITH {_KEYWORDS} SELECT query_id, keyword FROM kw")
def t26(spark, d):
    return _keywords(spark, d)


@query("j13_synonyms", f"WITH {_KEYWORDS} SELECT keyword, count(*) AS queries FROM kw GROUP BY 1")
def j13(spark, d):
    return _keywords(spark, d).groupBy("keyword").agg(F.count(F.lit(1)).alias("queries"))


_COUNTS = """k AS (SELECT DISTINCT keyword FROM kw), n AS (SELECT 'doc_' || doc_id AS uid, length(text) AS size, lang AS law_tag, keyword, (length(t) - length(replace(t, keyword, ''))) // length(keyword) AS n, instr(t, keyword) - 1 AS first, contains(lower(left(text, 60)), keyword) AS in_header, lower(left(text, 60)) AS head
FROM (SELECT *, lower(text) AS t FROM documents) JOIN k ON contains(t, keyword))"""


@query("a5_keyword_stats", f"WITH {_KEYWORDS}, {_COUNTS} SELECT uid, sum(n)::BIGINT AS occurrences, min(first) AS first_at, count(*) AS keywords FROM n GROUP BY uid")
def a5(spark, d):
    counts = retrieval.keyword_counts(_texts(spark, d), _keywords(spark, d))
    return counts.groupBy("uid").agg(F.sum("n").alias("occurrences"), F.min("first").alias("first_at"), F.count(F.lit(1)).alias("keywords"))


_SEARCH = f"""{_KEYWORDS}, {_COUNTS}, f AS (SELECT kw.query_id, n.uid, any_value(n.law_tag) AS law_tag, sum(n) AS n, min(first) AS first, any_value(size) AS size, count_if(in_header) AS headers, any_value(head) AS head FROM n JOIN kw USING (keyword) GROUP BY ALL),
m AS (SELECT *, contains(uid, '_' || ARTICLE) OR contains(head, '_' || ARTICLE) AS article_match FROM f),
g AS (SELECT query_id, uid, law_tag = 'en' AS law_match, article_match, round(least(0.58::DOUBLE, 0.30::DOUBLE + 0.10::DOUBLE * (n * 1000::DOUBLE / greatest(size, 1)) + 0.08::DOUBLE * headers + CASE WHEN first < 200 THEN 0.06::DOUBLE WHEN first < 500 THEN 0.03::DOUBLE ELSE 0::DOUBLE END
+ CASE WHEN size < 300 THEN -0.14::DOUBLE WHEN size < 500 THEN -0.07::DOUBLE ELSE 0::DOUBLE END + CASE WHEN article_match THEN 0.20::DOUBLE ELSE 0::DOUBLE END + CASE WHEN law_tag = 'en' THEN 0.04::DOUBLE ELSE 0::DOUBLE END), 6) AS similarity FROM m)"""
_SEARCH_ASKED = _SEARCH.replace("SELECT item_id AS query_id, text FROM benchmark", "SELECT query_id, text FROM ask").replace("ARTICLE", "query_id // 50")
_SEARCH = _SEARCH.replace("ARTICLE", "query_id")


def _keyword_hits(spark, d, k, queries=None, article=None):
    """All ask about English law and cite the article of their own number."""
    queries = _items(spark, d) if queries is None else queries
    laws = queries.select("query_id", F.lit("en").alias("law_tag"))
    cited = queries.select("query_id", F.concat(F.lit("_"), F.col("query_id") if article is None else article).alias("article"))
    return retrieval.keyword_search(_texts(spark, d), _keywords(spark, d, queries), k, articles=cited, laws=laws, header="header")


@query("r3_keyword_search", f"WITH {_SEARCH} SELECT query_id, uid, similarity FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, article_match DESC, law_match DESC, uid) <= 10")
def r3(spark, d):
    return _keyword_hits(spark, d, 10).select("query_id", "uid", "similarity")


_SEARCH_PLAIN = _SEARCH.replace("contains(uid, '_' || query_id) OR contains(head, '_' || query_id)", "false")


@query("r3_indexed_search", f"WITH {_SEARCH_PLAIN} SELECT query_id, uid, similarity FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, article_match DESC, law_match DESC, uid) <= 10")
def r3_indexed(spark, d):
    """The index is written, then searched by queries that cite no article."""
    path, queries = scratch(spark, "keywords"), _items(spark, d)
    keyword_index.build_keyword_index(_texts(spark, d), path, header="header")
    laws = queries.select("query_id", F.lit("en").alias("law_tag"))
    return keyword_index.indexed_search(spark, path, _keywords(spark, d), 10, laws=laws).select("query_id", "uid", "similarity")


@query("o2_keyword_top_k", f"WITH {_SEARCH} SELECT query_id, uid FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, article_match DESC, law_match DESC, uid) <= 25")
def o2(spark, d):
    return _keyword_hits(spark, d, 25).select("query_id", "uid")


# --- rules, parents, graph, fusion: benchmark texts ask, each with the vector of 50 times its number --------------------

_ASK = "ask AS (SELECT vec_id AS query_id, lower(text) AS text FROM embeddings JOIN benchmark ON item_id * 50 = vec_id)"
_ITEMS = "ask AS (SELECT item_id AS query_id, lower(text) AS text FROM benchmark)"
_RULED = """rule(rule_id, a, b, uid) AS (VALUES (1, 'the', 'tion', 'doc_1'), (2, 'and', 'of', 'doc_2'), (3, 'que', 'de', 'doc_7')),
forced AS (SELECT DISTINCT query_id, uid, 0.95::DOUBLE AS similarity FROM ask JOIN rule ON contains(text, a) AND contains(text, b) AND NOT contains(text, 'zz') WHERE uid IN (SELECT 'doc_' || doc_id FROM documents))"""


def _ask(spark, d):
    """Queries with their text and vector."""
    items = _items(spark, d).select((F.col("query_id") * 50).alias("query_id"), F.lower("text").alias("text"))
    return items.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")


def _forced(spark, d, queries):
    rules = spark.createDataFrame([(1, [["the"], ["tion"]], ["zz"], ["doc_1"]), (2, [["and"], ["of"]], ["zz"], ["doc_2"]), (3, [["que"], ["de"]], ["zz"], ["doc_7"])], "rule_id int, all_of array<array<string>>, none_of array<string>, uids array<string>")
    return retrieval.forced_hits(queries, rules, _all_chunks(spark, d).select(F.col("chunk_uid").alias("uid")))


def _all_chunks(spark, d):
    """Documents as chunks, every third one a part of the document before it."""
    parent = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("doc_"), F.col("doc_id") - 1))
    return table(spark, d, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("chunk_uid"), parent.alias("parent_chunk_uid"))


def _cites(spark, d):
    """The graph of parts and suppliers, with documents in their places; an edge a line, so that nothing is added up before
    the nodes that matter are picked."""
    lines = table(spark, d, "lineitem")
    node = lambda c: F.concat(F.lit("doc_"), c)
    return lines.select(node("l_partkey").alias("source_chunk_uid"), node("l_suppkey").alias("target_chunk_uid"), F.col("l_returnflag").alias("relation_type"), F.col("l_discount").alias("confidence"))


@query("j12_rule_forced", f"WITH {_ITEMS}, {_RULED} SELECT query_id, uid, similarity FROM forced")
def j12(spark, d):
    return _forced(spark, d, _items(spark, d)).select("query_id", "uid", "similarity")


@query("r4_rule_hits", f"WITH {_ITEMS}, {_RULED} SELECT uid, count(*) AS queries FROM forced GROUP BY 1")
def r4(spark, d):
    return _forced(spark, d, _items(spark, d)).groupBy("uid").agg(F.count(F.lit(1)).alias("queries"))


# Documents with vectors that are in force and public; the vectors of the queries.
_MATCHED = """vc AS (SELECT 'doc_' || d.doc_id AS uid, d.source AS source_type, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings JOIN documents d ON vec_id = d.doc_id LEFT JOIN labels l USING (doc_id) WHERE coalesce(toxic, 0) <> 1 AND d.doc_id % 4 = 0),
vq AS (SELECT query_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM ask JOIN embeddings ON vec_id = query_id),
vs AS (SELECT query_id, uid, source_type, round(list_dot_product(vq.e, vc.e) / (vq.n * vc.n), 6) AS similarity FROM vq, vc)"""
_ONE = "base AS (SELECT query_id, uid, similarity FROM vs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, uid) <= 10)"
#: Sources of a kind of document, in order.
_KINDS, _OTHER = {"manual": ["src0", "src1", "src2"]}, ["src0", "src3"]
_SOURCES = "base AS (SELECT query_id, uid, similarity FROM vs WHERE list_contains(CASE WHEN query_id % 100 = 0 THEN ['src0', 'src1', 'src2'] ELSE ['src0', 'src3'] END, source_type) QUALIFY row_number() OVER (PARTITION BY query_id, source_type ORDER BY similarity DESC, uid) <= 10)"


def _with_vectors(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return chunks(spark, d, flags=True).join(vectors, "doc_id").select(F.col("chunk_uid").alias("uid"), "embedding", "source_type", "is_derogada", "organization_id")


#: In force, and public, since no organisation asks.
_VISIBLE = "not is_derogada and organization_id is null"


def _vector_hits(spark, d, k):
    return retrieval.match_chunks(_ask(spark, d), _with_vectors(spark, d), k, where=F.expr(_VISIBLE))


def _source_hits(spark, d, k):
    """The k best of each source that the query's kind of document draws on."""
    kind = F.when(F.col("query_id") % 100 == 0, "manual").otherwise("other")
    asked = _ask(spark, d).withColumn("kind", kind).select("query_id", "embedding", F.explode(retrieval.source_priority("kind", _KINDS, _OTHER)).alias("source_type"))
    asked = asked.withColumn("query_id", F.concat_ws("|", "query_id", "source_type"))
    hits = retrieval.match_chunks(asked, _with_vectors(spark, d), k, by=["source_type"], where=F.expr(_VISIBLE))
    return hits.withColumn("query_id", F.substring_index("query_id", "|", 1).cast("long"))


def _fusion_sql(k: int, base: str = _ONE) -> str:
    """The steps up to the graph: e are the hits before it, near5 what it adds."""
    return f"""{_ASK}, {_MATCHED}, {base.replace('<= 10', f'<= {k}')}, {_SEARCH_ASKED}, {_RULED}, {EDGES.replace("'p_'", "'doc_'").replace("'s_'", "'doc_'")},
sym AS (SELECT source_chunk_uid AS node, target_chunk_uid AS neighbour, confidence FROM edges UNION ALL SELECT target_chunk_uid, source_chunk_uid, confidence FROM edges),
near AS (SELECT node, neighbour FROM (SELECT node, neighbour, max(confidence) AS confidence FROM sym GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY node ORDER BY confidence DESC, neighbour) <= 5),
a AS (SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, uid) <= {k}),
word AS (SELECT query_id, uid, similarity FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, article_match DESC, law_match DESC, uid) <= {min(k + 8, 25)}),
b AS (SELECT * FROM a UNION ALL SELECT * FROM word WHERE (query_id, uid) NOT IN (SELECT (query_id, uid) FROM a)),
c AS (SELECT b.query_id, b.uid, greatest(b.similarity, coalesce(r.similarity, 0)) AS similarity FROM b LEFT JOIN forced r USING (query_id, uid) UNION ALL SELECT * FROM forced WHERE (query_id, uid) NOT IN (SELECT (query_id, uid) FROM b)),
p AS (SELECT DISTINCT query_id, 'doc_' || (doc_id - 1) AS uid, 0.75::DOUBLE AS similarity FROM c JOIN documents ON uid = 'doc_' || doc_id WHERE doc_id % 3 = 1),
e AS (SELECT * FROM c UNION ALL SELECT * FROM p WHERE (query_id, uid) NOT IN (SELECT (query_id, uid) FROM c) AND uid IN (SELECT 'doc_' || doc_id FROM documents)),
votes AS (SELECT e.query_id, near.neighbour AS uid, count(DISTINCT e.uid) AS votes FROM e JOIN near ON node = e.uid GROUP BY ALL),
five AS (SELECT query_id, uid, 0.82::DOUBLE AS similarity FROM votes WHERE (query_id, uid) NOT IN (SELECT (query_id, uid) FROM e) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, uid) <= 5),
near5 AS (SELECT * FROM five WHERE uid IN (SELECT 'doc_' || doc_id FROM documents)),
h AS (SELECT * FROM e UNION ALL SELECT * FROM near5)"""


def _fused_sql(k: int, base: str = _ONE) -> str:
    return f"WITH {_fusion_sql(k, base)} SELECT query_id, uid, similarity FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, uid) <= {k}"


def _parts(spark, d, k, vector=_vector_hits):
    """Everything that hybrid search fuses, for k hits."""
    queries = _ask(spark, d)
    words = _keyword_hits(spark, d, retrieval.keyword_k(k), queries.select("query_id", "text"), (F.col("query_id") / 50).cast("long"))
    return vector(spark, d, k), words, _forced(spark, d, queries), _all_chunks(spark, d), _cites(spark, d), k


@query("r1_filtered", f"WITH {_ASK}, {_MATCHED} SELECT query_id, uid, similarity FROM vs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, uid) <= 10")
def r1_filtered(spark, d):
    """Vector search among the chunks that are in force and visible."""
    return _vector_hits(spark, d, 10).select("query_id", "uid", "similarity")


@query("h1_hybrid_search", _fused_sql(10))
def h1(spark, d):
    return retrieval.hybrid(*_parts(spark, d, 10)).select("query_id", "uid", "similarity")


@query("h2_conversation_preset", _fused_sql(20))
def h2(spark, d):
    return retrieval.hybrid(*_parts(spark, d, 20)).select("query_id", "uid", "similarity")


@query("h3_document_preset", _fused_sql(10, _SOURCES))
def h3(spark, d):
    return retrieval.hybrid(*_parts(spark, d, 10, _source_hits)).select("query_id", "uid", "similarity")


@query("j11_fusion_steps", f"WITH {_fusion_sql(10)}, hp AS (SELECT *, (query_id, uid) NOT IN (SELECT (query_id, uid) FROM c) AND (query_id, uid) IN (SELECT (query_id, uid) FROM e) AS parent FROM h) SELECT query_id, count(*) AS hits, max(similarity) AS best, count_if(parent) AS parents FROM hp GROUP BY 1")
def j11(spark, d):
    hits, near = retrieval.hybrid_steps(*_parts(spark, d, 10))
    return hits.unionByName(near).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.max("similarity").alias("best"), F.count_if(F.col("origin") == "parent").alias("parents"))


@query("o3_final_cut", _fused_sql(3))
def o3(spark, d):
    return retrieval.hybrid(*_parts(spark, d, 3)).select("query_id", "uid", "similarity")


@query("g1_graph_expansion", f"WITH {_fusion_sql(10)}, gv AS (SELECT a.query_id, near.neighbour AS uid, count(DISTINCT a.uid) AS votes FROM a JOIN near ON node = a.uid GROUP BY ALL) SELECT query_id, uid, 0.82::DOUBLE AS similarity FROM gv WHERE (query_id, uid) NOT IN (SELECT (query_id, uid) FROM a) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, uid) <= 5")
def g1(spark, d):
    return retrieval.expand_by_graph(_vector_hits(spark, d, 10).select("query_id", "uid"), _cites(spark, d)).select("query_id", "uid", "similarity")


_WALK = """w AS (SELECT o_orderkey AS case_id, o_orderpriority AS p, o_orderstatus AS s, CASE WHEN o_orderpriority = '1-URGENT' THEN 'fast' WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'state' END ELSE 'urgent' END AS node_id FROM orders)"""


@query("h4_routing", f"""WITH {_fusion_sql(10)}, {_WALK.replace("w AS", "walked AS", 1)}, tree AS (SELECT case_id AS query_id, node_id IN ('fast', 'done') AS done FROM walked WHERE case_id % 100 = 0), best AS (SELECT query_id, max(similarity) AS best FROM h GROUP BY 1)
SELECT item_id * 50 AS query_id, CASE WHEN done THEN 'tree' WHEN NOT done THEN 'tree_pending' WHEN best IS NULL OR best < 0.72 THEN 'live_lookup' ELSE 'rag' END AS route FROM benchmark LEFT JOIN tree ON tree.query_id = item_id * 50 LEFT JOIN best ON best.query_id = item_id * 50""")
def h4(spark, d):
    """Every second query is a case of the order of its number and goes through that order's tree; queries without a
    vector find nothing."""
    cases = _cases(spark, d).filter("case_id % 100 = 0")
    reached = trees.walk(cases, trees.node_table(_trees(spark, d))).select(F.col("case_id").alias("query_id"), "node_type")
    queries = _items(spark, d).select((F.col("query_id") * 50).alias("query_id"))
    return retrieval.route(queries, retrieval.hybrid(*_parts(spark, d, 10)), reached)


@query("a13_graph_lift", f"WITH {_fusion_sql(10)} SELECT query_id, count(DISTINCT e.uid) AS base_hits, (SELECT count(*) FROM near5 WHERE near5.query_id = e.query_id) AS added FROM e GROUP BY query_id")
def a13(spark, d):
    hits, near = retrieval.hybrid_steps(*_parts(spark, d, 10))
    return audit.lift(hits.select("query_id", "uid"), near)


@query("a12_retrieval_quality", f"WITH {_fusion_sql(10)}, t AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, uid) <= 10), q AS (SELECT query_id, bool_or(contains(uid, 'doc_1')) AS passed FROM t GROUP BY 1) SELECT query_id AS case_id, passed FROM q")
def a12(spark, d):
    hits = retrieval.hybrid(*_parts(spark, d, 10)).groupBy("query_id").agg(F.collect_list("uid").alias("hit_uids"), F.array_join(F.collect_list("uid"), " ").alias("context"))
    return audit.quality(hits.select(F.col("query_id").alias("case_id"), F.array(F.lit("doc_1")).alias("expected_uids"), F.array(F.lit("doc_")).alias("expected_strings"), "hit_uids", "context"))


# --- context -----------------------------------------------------------------------------------------------------------

_HEAD = f"""{_SEARCH}, top AS (SELECT query_id, uid, similarity FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, article_match DESC, law_match DESC, uid) <= 5),
head AS (SELECT t.query_id, t.uid, d.text, row_number() OVER (PARTITION BY t.query_id ORDER BY t.similarity DESC, t.uid) AS i, t.similarity, d.lang, d.source FROM top t JOIN documents d ON t.uid = 'doc_' || d.doc_id),
marked AS (SELECT *, '[' || i || '] | ' || CASE WHEN lang = 'en' THEN 'LEY: English law' ELSE 'TIPO: ' || upper(source[1]) || source[2:] END || ' | SECCIÓN: ' || source || ' | ARCHIVO: ' || uid || '.md | RELEVANCIA: ' || printf('%.2f', similarity) AS header FROM head)"""


def _headed(spark, d):
    titles = spark.createDataFrame([("en", "English law")], "law_tag string, title string")
    return retrieval.context_headers(_keyword_hits(spark, d, 5), _texts(spark, d), titles)


@query("t30_context_headers", f"WITH {_HEAD} SELECT query_id, uid, header FROM marked")
def t30(spark, d):
    return _headed(spark, d).select("query_id", "uid", "header")


_NOTES = "notes AS (SELECT item_id AS query_id, list_filter([CASE WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'the') THEN 'note one' END, CASE WHEN contains(lower(text), 'tion') THEN 'note two' END], lambda x: x IS NOT NULL) AS notes FROM benchmark)"


def _notes(spark, d):
    notes = spark.createDataFrame([(1, ["idiot", "the"], "note one"), (2, ["tion"], "note two")], "note_id int, any_of array<string>, note string")
    return retrieval.notes_for(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), notes)


@query("t32_domain_notes", f"WITH {_NOTES} SELECT query_id, array_to_string(notes, '|') AS notes FROM notes WHERE len(notes) > 0")
def t32(spark, d):
    return _notes(spark, d).select("query_id", F.array_join("notes", "|").alias("notes"))


_LINE = """concat_ws(' | ', CASE WHEN doc % 3 = 0 THEN 'Fecha: 2024-01-' || lpad((doc % 28 + 1)::VARCHAR, 2, '0') END, CASE WHEN lang = 'de' THEN 'Instancia: ' || source END, CASE WHEN doc % 4 <> 0 AND source <> 'src1' THEN 'PDF: https://x/' || source END)"""


@query("t31_context", rf"""WITH {_HEAD}, {_NOTES}, lined AS (SELECT *, {_LINE} AS line FROM (SELECT *, substr(uid, 5)::BIGINT AS doc FROM marked)),
b AS (SELECT query_id, string_agg(header || chr(10) || repeat('-', 60) || chr(10) || regexp_replace(regexp_replace(text, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') || chr(10) || CASE WHEN line <> '' THEN '  → ' || line || chr(10) ELSE '' END, chr(10) ORDER BY i) AS b FROM lined GROUP BY 1)
SELECT n.query_id, CASE WHEN b IS NULL THEN 'No relevant sources were found.' ELSE CASE WHEN len(notes) > 0 THEN '• ' || array_to_string(notes, chr(10) || '• ') || chr(10) || chr(10) ELSE '' END || b END AS context FROM notes n LEFT JOIN b USING (query_id)""")
def t31(spark, d):
    """Dates, instances and documents of hits come from their number, language and source."""
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    doc = F.substring("uid", 5, 20).cast("long")
    day = F.when(doc % 3 == 0, F.concat(F.lit("2024-01-"), F.lpad((doc % 28 + 1).cast("string"), 2, "0")))
    pdf = F.when(doc % 4 == 0, "").when(F.col("source_type") == "src1", "N/A").otherwise(F.concat(F.lit("https://x/"), "source_type"))
    meta = F.create_map(F.lit("fecha"), day, F.lit("instancia"), F.when(F.col("law_tag") == "de", F.col("source_type")), F.lit("pdf_url"), pdf)
    return retrieval.build_context(queries, _headed(spark, d).withColumn("metadata", meta), _notes(spark, d))


@query("t48_attachments", f"WITH {_HEAD} SELECT DISTINCT query_id, 'https://x/' || source AS url FROM head WHERE i <= 3 AND source <> 'src1'")
def t48(spark, d):
    head = _headed(spark, d).filter("i <= 3").select("query_id", F.when(F.col("source_type") == "src1", "N/A").otherwise(F.concat(F.lit("https://x/"), "source_type")).alias("url"))
    return head.filter("url <> 'N/A' and url <> ''").distinct()


# --- guardrail ---------------------------------------------------------------------------------------------------------

_PATTERNS = [r"Art[íi]culo ([0-9]+) de la ley de la [a-z]+", r"Art\. ([0-9]+) del DL-82[45]", r"DL-82[45]"]
_NAMES = [("renta", "lir"), ("dl-824", "lir"), ("dl-825", "iva")]


def _answers(spark, d):
    """Answers about order lines, with the line's own article in the context."""
    lines = spread(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))  # before there are texts to shuffle
    context = F.concat(F.lit("[1] | ARTÍCULO: Art. "), F.col("l_partkey"), F.lit(" | ley_lir_art_"), F.col("l_suppkey"), F.lit(" text Artículo 77 more"))
    answer = F.concat(F.lit("Según el Artículo "), F.col("l_suppkey"), F.lit(" de la ley de la renta y el Art. "), F.col("l_partkey") + 5_000_000, F.lit(" del DL-825, vivienda habitual exenta."))
    return lines.select("l_orderkey", "l_linenumber", context.alias("context"), answer.alias("answer"))


@query("t36_available_articles", "SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct([l_partkey::VARCHAR, 'lir:' || l_suppkey, '77'])), ',') AS articles FROM lineitem")
def t36(spark, d):
    return _answers(spark, d).select("l_orderkey", "l_linenumber", F.array_join(F.array_sort(guardrail.available_articles(F.col("context"))), ",").alias("articles"))


_CITED = """c AS (SELECT l_orderkey, l_linenumber, unnest([{'citation': 'Artículo ' || l_suppkey || ' de la ley de la renta', 'num': l_suppkey::VARCHAR, 'found': true}, {'citation': 'Art. ' || (l_partkey + 5000000) || ' del DL-825', 'num': (l_partkey + 5000000)::VARCHAR, 'found': false}, {'citation': 'DL-825', 'num': NULL, 'found': false}]) AS c FROM lineitem)"""


@query("t37_citations", f"WITH {_CITED} SELECT l_orderkey, l_linenumber, c.citation, c.num FROM c")
def t37(spark, d):
    return guardrail.verify(_answers(spark, d), _PATTERNS, _NAMES, context=None, dealt=True).select("l_orderkey", "l_linenumber", "citation", "num")


@query("t38_verification", f"WITH {_CITED} SELECT l_orderkey, l_linenumber, c.citation, c.found FROM c")
def t38(spark, d):
    return guardrail.verify(_answers(spark, d), _PATTERNS, _NAMES, dealt=True).select("l_orderkey", "l_linenumber", "citation", "found")


_BANNED = [("vivienda habitual.*exenta", "no such exemption"), ("plazo mínimo", "no such term")]


@query("t39_banned_concepts", "SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?is)the .* idiot') THEN 'a' END, CASE WHEN regexp_matches(text, '(?i)tion\\b') THEN 'b' END], lambda x: x IS NOT NULL), ';') AS messages FROM conversations")
def t39(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(guardrail.banned(F.col("text"), [("(?is)the .* idiot", "a"), (r"(?i)tion\b", "b")]), ";").alias("messages"))


@query("t40_annotated_answer", """SELECT l_orderkey, l_linenumber, 'Según el Artículo ' || l_suppkey || ' de la ley de la renta y el Art. ' || (l_partkey + 5000000) || ' del DL-825, vivienda habitual exenta.' || chr(10) || chr(10) || '[ALERTA] no such exemption' || chr(10) || chr(10) || '[WARN] ''Art. ' || (l_partkey + 5000000) || ' del DL-825'', ''DL-825''' AS answer FROM lineitem""")
def t40(spark, d):
    rows = guardrail.open_citations(_answers(spark, d), _PATTERNS, _NAMES, dealt=True)
    return rows.select("l_orderkey", "l_linenumber", guardrail.annotate(F.col("answer"), guardrail.banned(F.col("answer"), _BANNED), F.col("unverified")).alias("answer"))


# --- decision trees: one small tree per customer segment, every order a case -----------------------------------------

def _trees(spark, d):
    """A tree a market segment: is the order urgent, is it finished, else what follows."""
    from ..sources.readers import TREE

    segment = F.lower("c_mktsegment")
    body = F.format_string(
        '{"tree_id": "t_%1$s", "title": "Orders of %1$s", "law": "law", "article": "1", "tags": ["%1$s"], "root": {"id": "start", "type": "info", "summary": "begin", "next_node": "urgent"}, '
        '"nodes": {"urgent": {"id": "urgent", "type": "decision", "question": "Urgent?", "help": "see priority", "branches": [{"condition": "priority 1-urgent", "next_node": "fast"}, {"condition": "priority 2-high or 3-medium", "next_node": "state"}]}, '
        '"state": {"id": "state", "type": "decision", "question": "State?", "branches": [{"condition": "finished", "next_node": "done"}, {"condition": "open", "next_node": "missing"}]}, '
        '"fast": {"id": "fast", "type": "result", "summary": "ship now", "warnings": ["cost"], "next_steps": ["call"], "legal_ref": "art 1"}, "done": {"id": "done", "type": "result", "summary": "nothing to do"}}}', segment)
    rows = table(spark, d, "customer").select("c_mktsegment").distinct().select(F.from_json(body, TREE).alias("t"))
    return rows.select("t.*")


def _cases(spark, d):
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    facts = F.create_map(F.lit("priority"), F.lower("o_orderpriority"), F.lit("finished"), F.when(F.col("o_orderstatus") == "F", "true").otherwise("false"), F.lit("empty"), F.lit(""))
    return orders.select(F.col("o_orderkey").alias("case_id"), F.concat(F.lit("t_"), F.lower("c_mktsegment")).alias("tree_id"), facts.alias("facts"))


@query("d1_node_table", """SELECT 't_' || lower(seg) AS tree_id, u.node_id, u.is_root, u.branches FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer), (VALUES ('start', true, 0), ('urgent', false, 2), ('state', false, 2), ('fast', false, 0), ('done', false, 0)) u(node_id, is_root, branches)""")
def d1(spark, d):
    return trees.node_table(_trees(spark, d)).select("tree_id", "node_id", "is_root", F.size("branches").alias("branches"))


@query("d2_search_index", "SELECT lower(seg) AS key, 't_' || lower(seg) AS tree_id FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer) UNION ALL SELECT 'orders', max('t_' || lower(c_mktsegment)) FROM customer")
def d2(spark, d):
    return trees.search_index(_trees(spark, d))


def _scores(spark, d):
    queries = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("Orders about "), "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, " or building").otherwise("")).alias("text"))
    return trees.tree_scores(queries, trees.search_index(_trees(spark, d)))


_SCORES = """i AS (SELECT lower(seg) AS key, 't_' || lower(seg) AS tree_id FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer) UNION ALL SELECT 'orders', max('t_' || lower(c_mktsegment)) FROM customer),
sc AS (SELECT c_custkey AS query_id, tree_id, count(*) AS score FROM customer JOIN i ON contains(lower('Orders about ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ' or building' ELSE '' END), key) GROUP BY ALL)"""


@query("a11_tree_score", f"WITH {_SCORES} SELECT * FROM sc")
def a11(spark, d):
    return _scores(spark, d)


@query("d3_ranked_trees", f"WITH {_SCORES} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tree_id) AS rank FROM sc")
def d3(spark, d):
    return trees.ranked_trees(_scores(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query("d4_pick_tree", f"WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tree_id) AS rank FROM sc) SELECT a.query_id, a.tree_id, NOT (b.score IS NULL OR (a.score >= 2 AND a.score - b.score >= 2)) AS ambiguous FROM r a LEFT JOIN r b ON b.query_id = a.query_id AND b.rank = 2 WHERE a.rank = 1")
def d4(spark, d):
    return trees.pick_tree(_scores(spark, d))


@query("d5_branch_choice", "SELECT o_orderkey AS case_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'fast' WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'state' END AS target FROM orders")
def d5(spark, d):
    urgent = trees.node_table(_trees(spark, d)).filter("node_id = 'urgent'").select("tree_id", "branches")
    return _cases(spark, d).join(urgent, "tree_id").select("case_id", trees.next_by_facts(F.col("branches"), F.col("facts")).alias("target"))


@query("j14_case_branches", f"WITH {_WALK} SELECT node_id, count(*) AS cases FROM w GROUP BY 1")
def j14(spark, d):
    return trees.walk(_cases(spark, d), trees.node_table(_trees(spark, d))).groupBy("node_id").agg(F.count(F.lit(1)).alias("cases"))


_PATH = "CASE node_id WHEN 'fast' THEN 'start>urgent>fast' WHEN 'done' THEN 'start>urgent>state>done' WHEN 'state' THEN 'start>urgent>state' ELSE 'start>urgent' END"


@query("d6_walk", f"WITH {_WALK} SELECT case_id, node_id, CASE WHEN node_id IN ('fast', 'done') THEN 'result' ELSE 'decision' END AS node_type, {_PATH} AS path FROM w")
def d6(spark, d):
    return trees.walk(_cases(spark, d), trees.node_table(_trees(spark, d))).select("case_id", "node_id", "node_type", F.array_join("path", ">").alias("path"))


@query("d7_resume", f"WITH {_WALK} SELECT case_id, CASE WHEN node_id = 'state' THEN 'done' ELSE node_id END AS node_id, node_id = 'state' AS advanced FROM w WHERE node_id IN ('state', 'urgent')")
def d7(spark, d):
    nodes = trees.node_table(_trees(spark, d))
    stalled = trees.walk(_cases(spark, d), nodes).filter("node_type = 'decision'")
    more = stalled.select("case_id", F.create_map(F.lit("finished"), F.lit("true")).alias("more"))
    return trees.resume(stalled, more, nodes).select("case_id", "node_id", "advanced")


@query("d8_answer_text", f"""WITH {_WALK} SELECT case_id, 'Orders of ' || lower(c_mktsegment) || chr(10) || 'law | 1' || chr(10) || CASE node_id WHEN 'fast' THEN 'ship now' || chr(10) || chr(10) || 'ADVERTENCIAS:' || chr(10) || '  • cost' || chr(10) || chr(10) || 'PRÓXIMOS PASOS:' || chr(10) || '  • call' || chr(10) || chr(10) || 'FUNDAMENTO LEGAL:' || chr(10) || '  • art 1' ELSE 'nothing to do' END
|| chr(10) || chr(10) || 'Camino: ' || replace({_PATH}, '>', ' → ') AS answer FROM w JOIN orders ON o_orderkey = case_id JOIN customer ON c_custkey = o_custkey WHERE node_id IN ('fast', 'done')""")
def d8(spark, d):
    t = _trees(spark, d)
    nodes = trees.node_table(t)
    done = trees.walk(_cases(spark, d), nodes).filter("node_type = 'result'").drop("node_type")
    rows = done.join(nodes, ["tree_id", "node_id"]).join(t.select("tree_id", "title", "law", "article"), "tree_id")
    return rows.select("case_id", trees.answer_text().alias("answer"))


@query("d9_pending_question", f"""WITH {_WALK} SELECT case_id, CASE node_id WHEN 'urgent' THEN 'Urgent?' || chr(10) || 'see priority' || chr(10) || '1. priority 1-urgent' || chr(10) || '2. priority 2-high or 3-medium' ELSE 'State?' || chr(10) || '1. finished' || chr(10) || '2. open' END AS question FROM w WHERE node_id IN ('urgent', 'state')""")
def d9(spark, d):
    nodes = trees.node_table(_trees(spark, d))
    stalled = trees.walk(_cases(spark, d), nodes).filter("node_type = 'decision'").select("case_id", "tree_id", "node_id")
    return stalled.join(nodes, ["tree_id", "node_id"]).select("case_id", trees.pending_text().alias("question"))


@query("d10_tree_edges", """SELECT 't_' || lower(seg) AS tree_id, u.source, u.target, u.label FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer), (VALUES ('start', 'urgent', ''), ('urgent', 'fast', 'priority 1-urgent'), ('urgent', 'state', 'priority 2-high or 3-med'), ('state', 'done', 'finished'), ('state', 'missing', 'open')) u(source, target, label)""")
def d10(spark, d):
    return trees.tree_edges(trees.node_table(_trees(spark, d)))


@query("d11_dangling_targets", "SELECT DISTINCT 't_' || lower(c_mktsegment) AS tree_id, 'state' AS source, 'missing' AS target FROM customer")
def d11(spark, d):
    return trees.dangling(trees.node_table(_trees(spark, d))).select("tree_id", "source", "target")


@query("a10_tree_conditions", "SELECT DISTINCT 't_' || lower(c_mktsegment) AS tree_id, 'finished|open|priority 1-urgent|priority 2-high or 3-medium' AS conditions FROM customer")
def a10(spark, d):
    return trees.conditions(trees.node_table(_trees(spark, d))).select("tree_id", F.array_join("conditions", "|").alias("conditions"))


@query("a14_tree_catalogue", "SELECT DISTINCT 't_' || lower(c_mktsegment) AS tree_id, 'Orders of ' || lower(c_mktsegment) AS title, '1' AS article, 5 AS n_nodes FROM customer")
def a14(spark, d):
    return trees.catalogue(_trees(spark, d))


# --- embedding, sinks and streams ----------------------------------------------------------------------------------------

@query("v1_batch_embedding")
def v1(spark, d):
    from ..functions.embed import embed_column

    return table(spark, d, "documents").select("doc_id", embed_column(T.truncate(F.col("text")), 64).alias("embedding"))


@query("s12_replace_law", "SELECT doc_id, lang AS law_tag, CASE WHEN lang = 'de' AND doc_id % 2 = 0 THEN 2 ELSE 1 END AS version FROM documents WHERE lang <> 'de' OR doc_id % 2 = 0")
def s12(spark, d):
    """One law is replaced by fewer chunks, in one commit; the others' files stay as they are."""
    laws = VersionedTable(spark, scratch(spark, "laws"), "doc_id")
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("law_tag"))
    laws.upsert(rows.withColumn("version", F.lit(1)))
    laws.replace("law_tag", rows.filter("law_tag = 'de' and doc_id % 2 = 0").withColumn("version", F.lit(2)))
    return laws.read()


@query("s12_replace_partitions", "SELECT doc_id, lang AS law_tag, CASE WHEN lang = 'de' THEN 2 ELSE 1 END AS version FROM documents")
def s12_partitions(spark, d):
    from ..sources.sinks import replace_partitions

    path = scratch(spark, "laws")
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("law_tag"))
    rows.withColumn("version", F.lit(1)).write.partitionBy("law_tag").parquet(path)
    replace_partitions(rows.filter("law_tag = 'de'").withColumn("version", F.lit(2)), path, "law_tag")
    return spark.read.parquet(path).select("doc_id", "law_tag", "version")


@query("s10_versioned_upsert", f"""WITH {CHUNKS}, stored AS (SELECT chunk_uid, content_hash, 1 AS version FROM chunks WHERE source_type <> 'src1'),
hashes AS (SELECT DISTINCT content_hash FROM stored),
incoming AS (SELECT chunk_uid, CASE WHEN law_tag = 'de' THEN sha256(content || '!') ELSE content_hash END AS content_hash, 2 AS version FROM chunks),
fresh AS (SELECT * FROM incoming WHERE content_hash NOT IN (SELECT content_hash FROM hashes)),
now AS (SELECT * FROM fresh UNION ALL SELECT * FROM stored WHERE chunk_uid NOT IN (SELECT chunk_uid FROM fresh))
SELECT chunk_uid, content_hash, version FROM now WHERE chunk_uid NOT IN (SELECT chunk_uid FROM chunks WHERE doc_id % 11 = 0)""")
def s10_versioned(spark, d):
    """Commits of a store: chunks, an upsert of what is unseen with each uid twice, deletions, a broken commit, compaction."""
    c = chunks(spark, d)
    stored = VersionedTable(spark, scratch(spark, "store"))
    stored.upsert(c.filter("source_type <> 'src1'").select("chunk_uid", "content_hash", F.lit(1).alias("version")))
    incoming = c.select("chunk_uid", F.when(F.col("law_tag") == "de", F.sha2(F.concat("content", F.lit("!")), 256)).otherwise(F.col("content_hash")).alias("content_hash"), F.lit(2).alias("version"))
    stored.upsert(incoming.unionByName(incoming.withColumn("version", F.lit(3))), "version", unseen="content_hash")
    stored.delete(c.filter("doc_id % 11 = 0").select("chunk_uid"))
    stored.compact(range(stored.buckets // 2))
    stored._write(incoming.withColumn("_gone", F.lit(True)))  # data of a commit that broke off before its manifest
    return stored.read()


@query("s13_delete_insert", f"""WITH {CHUNKS} SELECT chunk_uid, content_hash FROM chunks WHERE NOT is_derogada
UNION ALL SELECT chunk_uid || '_new', sha256(content || ' ') FROM chunks WHERE is_derogada""")
def s13(spark, d):
    c = chunks(spark, d, flags=True)
    stored = VersionedTable(spark, scratch(spark, "store"))
    stored.upsert(c.select("chunk_uid", "content_hash"))
    gone = c.filter("is_derogada")
    stored.delete(gone, gone.select(F.concat("chunk_uid", F.lit("_new")).alias("chunk_uid"), F.sha2(F.concat("content", F.lit(" ")), 256).alias("content_hash")))
    return stored.read()


def _written_records(spark, d, name: str) -> str:
    """Documents written as text files, one folder each, to be read back by the markdown readers."""
    path = scratch(spark, "records")
    table(spark, d, "documents").select("text").write.option("lineSep", "\u0001").text(path)
    return path


@query("s1_ruling_files", "SELECT sum(length(text))::BIGINT AS chars, count(*) AS records FROM documents")
def s1(spark, d):
    from ..sources.readers import read_markdown

    files = read_markdown(spark, _written_records(spark, d, "s1"), "part-*.txt")
    rows = files.select(F.explode(F.split("content", "\u0001")).alias("t")).filter("t <> ''")
    return rows.agg(F.sum(F.length("t")).alias("chars"), F.count(F.lit(1)).alias("records"))


@query("s2_circular_files", "SELECT min(sha256(text)) AS least, max(sha256(text)) AS greatest FROM documents")
def s2(spark, d):
    from ..sources.readers import read_markdown

    files = read_markdown(spark, _written_records(spark, d, "s2"), "part-*.txt")
    rows = files.select(F.explode(F.split("content", "\u0001")).alias("t")).filter("t <> ''")
    return rows.agg(F.min(F.sha2("t", 256)).alias("least"), F.max(F.sha2("t", 256)).alias("greatest"))


@query("s5_tree_files", "SELECT DISTINCT 't_' || lower(c_mktsegment) AS tree_id, 4 AS n_nodes FROM customer")
def s5(spark, d):
    from ..sources.readers import read_trees

    path = scratch(spark, "trees")
    _trees(spark, d).repartition(5).write.option("ignoreNullFields", True).json(path)
    good, _ = read_trees(spark, path)
    return good.select("tree_id", F.size("nodes").alias("n_nodes"))


@query("st1_incremental_ingest", f"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR source IS NULL THEN '' ELSE 'Resumen:' || chr(10) || source || chr(10) || chr(10) END || 'Contenido:' || chr(10) || {_STRIP("replace(text, '## ', '')")} AS content FROM documents WHERE {_STRIP('text')} NOT IN ('', '.'))
SELECT sha256(content) AS content_hash, any_value(CASE WHEN contains(lower(content), 'idiot') OR contains(lower(content), 'lowei') THEN 'a' WHEN contains(lower(content), 'license') THEN 'b' ELSE 'ley' END) AS law_tag, any_value(length(content))::BIGINT AS chars, count_if(doc_id % 2 = 0) > 0 AS in_first FROM r GROUP BY 1""")
def st1(spark, d):
    """Markdown files, one a document: half of them, then all, those of the first half again. All rows come from the store."""
    files, log = scratch(spark, "files"), scratch(spark, "log")
    store = VersionedTable(spark, scratch(spark, "store"))
    records = markdown_of(spark, d)
    for n, part in enumerate((records.filter("doc_id % 2 = 0"), records)):
        write_files(spread(part.select("record")), f"{files}/{n}")
        streams.ingest_files(spark, files, "part-*.txt", store, log, prefix="ruling_", laws=[("a", ["idiot", "lowei"]), ("b", ["license"])])
    return store.read().select("content_hash", "law_tag", F.length("content").cast("long").alias("chars"), (F.col("batch") == 0).alias("in_first"))


@query("st2_query_log_stream", "SELECT user_id AS chat_id, count(*) AS n FROM events GROUP BY 1")
def st2(spark, d):
    path = scratch(spark, "log")
    events = streams.as_stream(spark, f"{d}/events.parquet", table(spark, d, "events").schema)
    streams.append_log(events.select(F.col("user_id").alias("chat_id"), F.col("props").alias("query_text")), path, f"{path}-log")
    return spark.read.parquet(path).groupBy("chat_id").agg(F.count(F.lit(1)).alias("n"))


_REPLY = "CASE WHEN event_type = 'click' THEN (floor(value)::BIGINT % 4)::VARCHAR ELSE event_type END"


@query("st3_pending_cases", f"""WITH e AS (SELECT *, event_type IN ('purchase', 'error') AS closes FROM events),
g AS (SELECT *, sum(closes::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) - closes::INT AS part FROM e),
b AS (SELECT *, coalesce(max((event_type = 'signup')::INT) OVER (PARTITION BY user_id, part ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS asked FROM g),
f AS (SELECT DISTINCT user_id, part, CASE WHEN asked AND {_REPLY} = '1' THEN 'priority 1-urgent' WHEN asked AND {_REPLY} = '2' THEN 'priority 2-high or 3-medium' ELSE {_REPLY} END AS fact FROM b WHERE event_type IN ('click', 'view')),
j AS (SELECT user_id, part, string_agg(fact, ',' ORDER BY fact) AS facts FROM f GROUP BY ALL)
SELECT b.user_id AS chat_id, ts AS closed_at, CASE WHEN event_type = 'purchase' THEN 'result' ELSE 'topic' END AS closed_by, coalesce(facts, '') AS facts FROM b LEFT JOIN j USING (user_id, part) WHERE closes""")
def st3(spark, d):
    """A sign-up brings the question of the trees' second node; clicks answer with a number, views with a text."""
    path = scratch(spark, "pending")
    events = streams.as_stream(spark, f"{d}/events.parquet", table(spark, d, "events").schema)
    kind = F.when(F.col("event_type") == "purchase", "result").when(F.col("event_type") == "error", "topic").when(F.col("event_type") == "signup", "pending").otherwise("answer")
    fact = F.when(F.col("event_type") == "click", (F.floor("value") % 4).cast("string")).otherwise(F.col("event_type"))
    asked = trees.node_table(_trees(spark, d)).filter("node_id = 'urgent'").select(F.col("branches.condition").alias("c")).first()["c"]  # one node
    branches = F.when(F.col("event_type") == "signup", F.array(*map(F.lit, asked)))
    rows = events.select(F.col("user_id").alias("chat_id"), "ts", kind.alias("kind"), fact.alias("fact"), branches.alias("branches"))
    streams.pending_cases(rows, path, f"{path}-log")
    return spark.read.parquet(path)
