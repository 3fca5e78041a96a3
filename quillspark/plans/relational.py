"""Queries over stores, graph and audits, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, graph, store
from .tables import CHUNKS, EDGES, LAW_CHUNKS, chunks, edges, law_chunks, query_log, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- sources and sinks -------------------------------------------------------------------------------------------

@query("s3_pages_to_text", """SELECT conv_id, string_agg(text || chr(10), '' ORDER BY turn) AS law_text, count(*) AS pages
FROM conversations WHERE text <> '' GROUP BY conv_id""")
def s3(spark, d):
    from ..sources.readers import pages_to_text

    return pages_to_text(table(spark, d, "conversations"), "conv_id", "turn", "text").withColumnRenamed("pages_text", "law_text")


@query("s4_select_files", """SELECT page_id, lower(regexp_extract(url, '([^/]*)$', 1)) AS filename FROM pages
WHERE list_bool_or([contains(lower(regexp_extract(url, '([^/]*)$', 1)), k) FOR k IN ['html', 'feed', 'top', '11', '22', '33']])""")
def s4(spark, d):
    from ..sources.readers import named_like

    files = table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", "([^/]*)$", 1)).alias("filename"))
    return named_like(files, "filename", ["html", "feed", "top", "11", "22", "33"])


@query("s6_index_links", r"""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href="/([^"]+)">([^<]*)</a>', 0)) AS m FROM pages)
SELECT page_id, regexp_extract(m, '(?i)href="/([^"]+)">([^<]*)</a>', 1) AS target, regexp_extract(m, '(?i)href="/([^"]+)">([^<]*)</a>', 2) AS title,
'doc-' || page_id || '-' || regexp_extract(m, '(?i)href="/([^"]+)">([^<]*)</a>', 1) AS doc_ref, 'https://base/' || regexp_extract(m, '(?i)href="/([^"]+)">([^<]*)</a>', 1) AS url FROM m""")
def s6(spark, d):
    from ..sources.readers import index_links

    links = index_links(table(spark, d, "pages"), r'(?i)href="/([^"]+)">([^<]*)</a>')
    return links.select("page_id", "target", "title", F.concat_ws("-", F.lit("doc"), "page_id", "target").alias("doc_ref"), F.concat(F.lit("https://base/"), "target").alias("url"))


@query("s7_linked_years", r"""WITH y AS (SELECT page_id, list_sort(list_distinct([m[2:]::INT FOR m IN regexp_extract_all(html, '[ ](19|20)[0-9]{2}', 0)])) AS y FROM pages)
SELECT page_id, unnest(CASE WHEN len(y) > 0 THEN y ELSE range(2015, 2019) END)::INT AS year FROM y""")
def s7(spark, d):
    from ..sources.readers import linked_years

    return linked_years(table(spark, d, "pages"), "html", r"[ ]((?:19|20)[0-9]{2})", 2015, 2018).select("page_id", "year")


@query("s8_ruling_records", """SELECT event_id, 'ruling-' || event_id AS ruling_id, event_type AS kind, strftime(ts, '%Y-%m-%d') AS date,
CASE WHEN coalesce(json_extract_string(props, '$.k'), '') = '' THEN '.' ELSE json_extract_string(props, '$.k') END AS summary, 'N/A' AS url,
'## Metadata' || chr(10) || '- id: ruling-' || event_id || chr(10) || '- fecha: ' || strftime(ts, '%Y-%m-%d') || chr(10) || '- tipo: ' || event_type || chr(10) || '- pdf_url: N/A' || chr(10) || chr(10) || '## Resumen' || chr(10)
|| CASE WHEN coalesce(json_extract_string(props, '$.k'), '') = '' THEN '.' ELSE json_extract_string(props, '$.k') END || chr(10) || chr(10) || '## Contenido' || chr(10) || '.' AS markdown FROM events""")
def s8(spark, d):
    from ..sources.readers import ruling_records

    raw = F.to_json(F.struct(F.concat(F.lit("ruling-"), "event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("fecha"), F.struct(F.col("event_type").alias("nombre")).alias("tipoPronunciamiento"), F.get_json_object("props", "$.k").alias("resumen")))
    return ruling_records(table(spark, d, "events").select("event_id", raw.alias("json")), "json").select("event_id", F.col("id").alias("ruling_id"), "kind", "date", "summary", "url", "markdown")


@query("s9_circular_markdown", """SELECT o_orderkey, '## Metadata' || chr(10) || '- id: circular-' || year(o_orderdate) || '-' || o_orderkey || chr(10) || '- fecha: ' || year(o_orderdate) || '-01-01' || chr(10)
|| '- estado_vigencia: ' || CASE o_orderstatus WHEN 'F' THEN 'derogada' ELSE 'vigente' END || chr(10) || '- pdf_url: N/A' || chr(10) || chr(10) || '## Resumen' || chr(10) || o_orderpriority || chr(10) || chr(10) || '## Contenido' || chr(10) || '.' AS markdown FROM orders""")
def s9(spark, d):
    from ..sources.readers import markdown_layout

    meta = [("id", F.concat_ws("-", F.lit("circular"), F.year("o_orderdate"), "o_orderkey")), ("fecha", F.concat(F.year("o_orderdate"), F.lit("-01-01"))), ("estado_vigencia", F.when(F.col("o_orderstatus") == "F", "derogada").otherwise("vigente")), ("pdf_url", F.lit("N/A"))]
    return table(spark, d, "orders").select("o_orderkey", markdown_layout(meta, F.col("o_orderpriority"), F.lit(".")).alias("markdown"))


@query("s10_chunk_upsert", f"""WITH {CHUNKS}, stored AS (SELECT chunk_uid, law_tag, content_hash, 1 AS version FROM chunks WHERE source_type <> 'src1'),
incoming AS (SELECT chunk_uid, law_tag, sha256(content || '!') AS content_hash, 2 AS version FROM chunks WHERE (law_tag = 'de' OR source_type = 'src1') AND doc_id % 7 <> 0)
SELECT * FROM incoming UNION ALL SELECT * FROM stored WHERE chunk_uid NOT IN (SELECT chunk_uid FROM incoming)""")
def s10(spark, d):
    """Every incoming uid comes twice, the later one last; every seventh has vectors of a wrong length."""
    c = chunks(spark, d)
    stored = c.filter("source_type <> 'src1'").select("chunk_uid", "law_tag", "content_hash", F.lit(1).alias("version"))
    incoming = c.filter("law_tag = 'de' or source_type = 'src1'").select("chunk_uid", "law_tag", F.sha2(F.concat("content", F.lit("!")), 256).alias("content_hash"), F.lit(2).alias("version"), F.array_repeat(F.lit(1.0), F.when(F.col("doc_id") % 7 == 0, 3).otherwise(4)).alias("embedding"))
    again = incoming.withColumns({"version": F.lit(3), "content_hash": F.reverse("content_hash")})
    return store.upsert(stored, store.new_rows(incoming.unionByName(again), stored), order=["version"], dimension=("embedding", 4))


@query("s11_edge_append", f"""WITH {EDGES} SELECT 's_' || l_suppkey AS source_chunk_uid, 'p_' || l_partkey AS target_chunk_uid, l_linestatus AS relation_type, arg_min(l_tax, (l_orderkey, l_linenumber, -l_tax)) AS confidence FROM lineitem GROUP BY ALL
UNION ALL SELECT 'p_' || l_partkey, 's_' || l_suppkey, 'N2', arg_min(l_tax, (l_orderkey, l_linenumber, -l_tax)) FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL""")
def s11(spark, d):
    lines = table(spark, d, "lineitem")
    p, s = F.concat(F.lit("p_"), "l_partkey"), F.concat(F.lit("s_"), "l_suppkey")
    back = lines.select(s.alias("source_chunk_uid"), p.alias("target_chunk_uid"), F.col("l_linestatus").alias("relation_type"), F.col("l_tax").alias("confidence"), "l_orderkey", "l_linenumber")
    again = lines.select(p.alias("source_chunk_uid"), s.alias("target_chunk_uid"), F.col("l_returnflag").alias("relation_type"), F.col("l_tax").alias("confidence"), "l_orderkey", "l_linenumber")
    renamed = again.filter("relation_type = 'N'").withColumn("relation_type", F.lit("N2"))
    return store.append_edges(edges(spark, d), back.unionByName(again).unionByName(renamed), "l_orderkey", "l_linenumber")


@query("s14_query_log", "SELECT event_id, user_id AS chat_id, 'chat' AS query_type, substr(repeat(props || ' ', 300), 1, 2000) AS query_text FROM events")
def s14(spark, d):
    from ..sources.sinks import log_rows

    return log_rows(table(spark, d, "events").select("event_id", F.col("user_id").alias("chat_id"), F.repeat(F.concat("props", F.lit(" ")), 300).alias("query_text")))


@query("s15_latest_session", "SELECT chat_id, id, query_type FROM (SELECT user_id AS chat_id, event_id AS id, event_type AS query_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def s15(spark, d):
    return store.latest(query_log(spark, d), ["chat_id"], ["id", "query_type"], "id")


@query("s16_latest_setting", """WITH l AS (SELECT user_id AS chat_id, event_type AS key, arg_max(value, struct_pack(a := ts, b := event_id)) AS value FROM events GROUP BY ALL),
k AS (SELECT c.chat_id, t.key FROM (SELECT DISTINCT user_id AS chat_id FROM events) c, (VALUES ('click'), ('view'), ('absent')) t(key))
SELECT k.chat_id, k.key, coalesce(l.value, -1.0) AS value FROM k LEFT JOIN l USING (chat_id, key)""")
def s16(spark, d):
    log = query_log(spark, d)
    last = store.latest(log.withColumnRenamed("query_type", "key"), ["chat_id", "key"], ["value"], "created_at", "id")
    wanted = log.select("chat_id").distinct().withColumn("key", F.explode(F.array(F.lit("click"), F.lit("view"), F.lit("absent"))))
    return wanted.join(last, ["chat_id", "key"], "left").select("chat_id", "key", F.coalesce("value", F.lit(-1.0)).alias("value"))


@query("s18_incremental_sync", """WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R')
SELECT l_returnflag AS flag, count(*) AS total, count_if((l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM s)) AS fresh FROM lineitem GROUP BY 1""")
def s18(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").alias("item_id"), F.col("l_returnflag").alias("flag"))
    new = store.synced(items, items.filter("flag = 'R'")).groupBy("flag").agg(F.count(F.lit(1)).alias("fresh"))
    return items.groupBy("flag").agg(F.count(F.lit(1)).alias("total")).join(new, "flag", "left").select("flag", "total", F.coalesce("fresh", F.lit(0)).alias("fresh"))


@query("s19_markdown_export", "SELECT doc_id, '# Document ' || doc_id || chr(10) || chr(10) || '_2024-01-31_' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || text AS markdown FROM documents")
def s19(spark, d):
    from ..sources.sinks import markdown_document

    return table(spark, d, "documents").select("doc_id", markdown_document(F.concat(F.lit("Document "), "doc_id"), F.lit("2024-01-31"), F.col("text")).alias("markdown"))


@query("s21_upload_ledger", """WITH f AS (SELECT lang AS target, substr(sha256(text), 1, 16) AS digest, source FROM documents), k AS (SELECT DISTINCT target, digest FROM f WHERE source <> 'src1')
SELECT f.target, count_if(k.digest IS NULL) AS uploaded, count_if(k.digest IS NOT NULL) AS skipped FROM f LEFT JOIN k USING (target, digest) GROUP BY 1""")
def s21(spark, d):
    files = table(spark, d, "documents").select(F.col("lang").alias("target"), F.col("text").alias("content"), "source")
    ledger = files.filter("source <> 'src1'").select("target", F.substring(F.sha2("content", 256), 1, 16).alias("digest"))
    return store.upload_outcomes(files, ledger)


# --- projections and filters -------------------------------------------------------------------------------------

@query("p1_pruned_scan", f"WITH {CHUNKS} SELECT chunk_uid, law_tag, length(content) AS chars FROM chunks WHERE source_type = 'src1'")
def p1(spark, d):
    return chunks(spark, d).filter("source_type = 'src1'").select("chunk_uid", "law_tag", F.length("content").cast("long").alias("chars"))


@query("p2_optional_filters", f"WITH {CHUNKS} SELECT chunk_uid FROM chunks WHERE source_type = 'src0' AND law_tag = 'en'")
def p2(spark, d):
    return store.visible(chunks(spark, d), ["src0"], ["en"], include_derogated=True, all_tenants=True).select("chunk_uid")


@query("p3_validity", f"WITH {CHUNKS} SELECT chunk_uid FROM chunks WHERE NOT is_derogada")
def p3(spark, d):
    return store.visible(chunks(spark, d, flags=True), all_tenants=True).select("chunk_uid")


@query("p4_tenant_visibility", f"WITH {CHUNKS} SELECT chunk_uid, organization_id FROM chunks WHERE organization_id IS NULL OR organization_id = '2'")
def p4(spark, d):
    return store.visible(chunks(spark, d), include_derogated=True, organization="2").select("chunk_uid", "organization_id")


@query("p5_multi_value", f"WITH {CHUNKS} SELECT chunk_uid FROM chunks WHERE source_type IN ('src0', 'src3') AND law_tag IN ('en', 'es') AND NOT is_derogada")
def p5(spark, d):
    return store.visible(chunks(spark, d, flags=True), ["src0", "src3"], ["en", "es"], all_tenants=True).select("chunk_uid")


@query("p6_exact_else_prefix", f"""WITH {LAW_CHUNKS}, w AS (SELECT DISTINCT 'ley_' || law_tag || '_art_' || num AS uid FROM law_chunks UNION SELECT DISTINCT chunk_uid FROM law_chunks WHERE chunk_index = 2)
SELECT w.uid, CASE WHEN e.chunk_uid IS NOT NULL THEN e.chunk_uid ELSE p.first END AS chunk_uid FROM w LEFT JOIN (SELECT DISTINCT chunk_uid FROM law_chunks) e ON e.chunk_uid = w.uid
LEFT JOIN (SELECT 'ley_' || law_tag || '_art_' || num AS uid, min(chunk_uid) AS first FROM law_chunks GROUP BY 1) p ON p.uid = w.uid""")
def p6(spark, d):
    c = law_chunks(spark, d)
    wanted = c.select(F.concat_ws("_", F.lit("ley"), "law_tag", F.lit("art"), "num").alias("uid")).union(c.filter("chunk_index = 2").select("chunk_uid")).distinct()
    return graph.fetch(wanted, c)


@query("p7_nonempty", "SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND text <> ''")
def p7(spark, d):
    return table(spark, d, "conversations").filter(store.nonempty("text")).select("conv_id", "turn")


@query("p8_either_endpoint", f"""WITH {EDGES} SELECT source_chunk_uid AS node, target_chunk_uid AS neighbour, relation_type, confidence FROM edges WHERE relation_type IN ('A', 'R')
UNION ALL SELECT target_chunk_uid, source_chunk_uid, relation_type, confidence FROM edges WHERE relation_type IN ('A', 'R')""")
def p8(spark, d):
    return graph.symmetric(edges(spark, d), ["A", "R"])


@query("p9_any_keyword", "SELECT item_id FROM benchmark WHERE contains(lower(text), 'tion') OR contains(lower(text), 'idiot') OR contains(lower(text), 'handes')")
def p9(spark, d):
    return table(spark, d, "benchmark").filter(store.any_keyword("text", ["tion", "idiot", "handes"])).select("item_id")


@query("p11_content_type_sources", """SELECT event_id, CASE event_type WHEN 'view' THEN 'ley,circular' WHEN 'click' THEN 'jurisprudencia,ley' ELSE 'ley' END AS sources FROM events""")
def p11(spark, d):
    from ..operators.retrieval import source_priority

    priorities = {"view": ["ley", "circular"], "click": ["jurisprudencia", "ley"]}
    return table(spark, d, "events").select("event_id", F.array_join(source_priority("event_type", priorities, ["ley"]), ",").alias("sources"))


@query("p12_min_length", """SELECT doc_id, length(text) AS chars, (SELECT count_if(length(text) < 500) FROM documents) AS below_batch_limit FROM documents WHERE length(text) >= 100""")
def p12(spark, d):
    return store.long_enough(table(spark, d, "documents"), "text", 100, 500).select("doc_id", "chars", "below_batch_limit")


# --- joins ---------------------------------------------------------------------------------------------------------

@query("j1_new_rows", f"WITH {CHUNKS} SELECT chunk_uid FROM chunks WHERE source_type = 'src0' AND content_hash NOT IN (SELECT content_hash FROM chunks WHERE source_type <> 'src0')")
def j1(spark, d):
    c = chunks(spark, d)
    return store.new_rows(c.filter("source_type = 'src0'"), c.filter("source_type <> 'src0'")).select("chunk_uid")


_NEAR = f"""{EDGES}, sym AS (SELECT source_chunk_uid AS node, target_chunk_uid AS neighbour, confidence FROM edges UNION ALL SELECT target_chunk_uid, source_chunk_uid, confidence FROM edges),
near AS (SELECT node, neighbour, confidence FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY confidence DESC, neighbour) AS n FROM (SELECT node, neighbour, max(confidence) AS confidence FROM sym GROUP BY ALL)) WHERE n <= 5)"""


@query("j3_neighbourhood", f"""WITH {_NEAR}, seeds AS (SELECT DISTINCT 's_' || s_suppkey AS seed FROM supplier), a AS (SELECT DISTINCT seed, neighbour AS uid FROM seeds JOIN near ON node = seed),
b AS (SELECT DISTINCT a.seed, n.neighbour AS uid FROM a JOIN near n ON n.node = a.uid WHERE n.neighbour <> a.seed AND (a.seed, n.neighbour) NOT IN (SELECT (seed, uid) FROM a))
SELECT seed, uid, 1 AS level FROM a UNION ALL SELECT seed, uid, 2 FROM b""")
def j3(spark, d):
    seeds = table(spark, d, "supplier").select(F.concat(F.lit("s_"), "s_suppkey").alias("uid"))
    return graph.neighbourhood(edges(spark, d), seeds, depth=2)


@query("j3_three_steps", f"""WITH RECURSIVE {_NEAR}, w(seed, uid, level) AS (SELECT DISTINCT 's_' || s_suppkey, 's_' || s_suppkey, 0 FROM supplier
UNION SELECT w.seed, n.neighbour, w.level + 1 FROM w JOIN near n ON n.node = w.uid WHERE w.level < 3)
SELECT seed, uid, min(level) AS level FROM w GROUP BY ALL HAVING min(level) > 0""")
def j3_three(spark, d):
    seeds = table(spark, d, "supplier").select(F.concat(F.lit("s_"), "s_suppkey").alias("uid"))
    return graph.neighbourhood(edges(spark, d), seeds, depth=3)


@query("j4_fetch_by_uid", f"""WITH {LAW_CHUNKS} SELECT 'ley_' || law_tag || '_art_' || num AS uid, min(chunk_uid) AS chunk_uid FROM law_chunks GROUP BY 1""")
def j4(spark, d):
    c = law_chunks(spark, d)
    return graph.fetch(c.select(F.concat_ws("_", F.lit("ley"), "law_tag", F.lit("art"), "num").alias("uid")), c)


@query("j5_parents", """WITH c AS (SELECT 'l' || l_orderkey || '_' || l_linenumber AS chunk_uid, 'l' || l_orderkey || '_1' AS parent_chunk_uid, l_shipdate::DATE AS query_id, l_quantity FROM lineitem),
h AS (SELECT query_id::VARCHAR AS query_id, chunk_uid, parent_chunk_uid FROM c WHERE l_quantity >= 45)
SELECT DISTINCT h.query_id, h.parent_chunk_uid AS uid, 0.75 AS similarity FROM h JOIN c p ON p.chunk_uid = h.parent_chunk_uid WHERE (h.query_id, h.parent_chunk_uid) NOT IN (SELECT (query_id, chunk_uid) FROM h)""")
def j5(spark, d):
    from ..operators.retrieval import parent_hits

    lines = table(spark, d, "lineitem")
    uid = F.concat(F.lit("l"), "l_orderkey", F.lit("_"), "l_linenumber")
    c = lines.select(uid.alias("chunk_uid"), F.concat(F.lit("l"), "l_orderkey", F.lit("_1")).alias("parent_chunk_uid"))
    hits = lines.filter("l_quantity >= 45").select(F.to_date("l_shipdate").cast("string").alias("query_id"), uid.alias("uid"), F.lit(0.5).alias("similarity"))
    return parent_hits(hits, c).select("query_id", "uid", "similarity")


@query("j6_broken_edges", f"WITH {EDGES}, k AS (SELECT 'p_' || p_partkey AS uid FROM part WHERE p_size <= 40 UNION SELECT 's_' || s_suppkey FROM supplier) SELECT * FROM edges WHERE source_chunk_uid NOT IN (SELECT uid FROM k) OR target_chunk_uid NOT IN (SELECT uid FROM k)")
def j6(spark, d):
    known = table(spark, d, "part").filter("p_size <= 40").select(F.concat(F.lit("p_"), "p_partkey").alias("chunk_uid")).union(table(spark, d, "supplier").select(F.concat(F.lit("s_"), "s_suppkey")))
    return graph.broken(edges(spark, d), known).select("source_chunk_uid", "target_chunk_uid", "relation_type", "confidence")


_ARTICLES = """SELECT 'law' || o_custkey % 7 AS law_tag, o_orderkey AS num FROM orders WHERE o_orderstatus <> 'P'"""


@query("j7_article_coverage", f"""WITH a AS ({_ARTICLES}), b AS (SELECT 'law' || o_custkey % 7 AS law_tag, o_orderkey AS num FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT law_tag, num, 'missing' AS status FROM (SELECT DISTINCT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT law_tag, num, 'extra' FROM (SELECT DISTINCT * FROM b EXCEPT SELECT * FROM a)""")
def j7(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("law"), F.col("o_custkey") % 7).alias("law_tag"), F.col("o_orderkey").alias("num"), "o_orderstatus", "o_orderpriority")
    return audit.coverage(o.filter("o_orderstatus <> 'P'"), o.filter("o_orderpriority <> '5-LOW'"))


@query("j8_must_exist", f"""WITH {LAW_CHUNKS}, k AS (SELECT DISTINCT law_tag, num::VARCHAR AS article FROM law_chunks UNION SELECT DISTINCT law_tag, num || '_' || chunk_index FROM law_chunks),
r AS (SELECT DISTINCT 'law' || c_nationkey AS law_tag, o_orderkey::VARCHAR AS article FROM orders JOIN customer ON c_custkey = o_custkey UNION SELECT 'law' || n_nationkey, '1_99' FROM nation)
SELECT law_tag, article FROM r WHERE (law_tag, article) NOT IN (SELECT (law_tag, article) FROM k)""")
def j8(spark, d):
    c = law_chunks(spark, d).select("law_tag", F.concat_ws("_", "num", "chunk_index").alias("article"))
    required = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.concat(F.lit("law"), "c_nationkey").alias("law_tag"), F.col("o_orderkey").cast("string").alias("article"))
    required = required.union(table(spark, d, "nation").select(F.concat(F.lit("law"), "n_nationkey"), F.lit("1_99"))).distinct()
    return audit.must_exist(required, c)


@query("j9_critical_content", f"""WITH {CHUNKS}, k AS (SELECT 'doc_' || doc_id AS chunk_uid, ['the', 'idiot'] AS kw FROM labels UNION ALL SELECT 'none_' || n_nationkey, ['x'] FROM nation)
SELECT k.chunk_uid, CASE WHEN c.content IS NULL THEN 'absent chunk' WHEN len(list_filter(kw, lambda w: NOT contains(lower(c.content), w))) > 0 THEN 'incomplete' ELSE 'ok' END AS status,
CASE WHEN c.content IS NULL THEN array_to_string(kw, ',') ELSE array_to_string(list_filter(kw, lambda w: NOT contains(lower(c.content), w)), ',') END AS absent FROM k LEFT JOIN chunks c USING (chunk_uid)""")
def j9(spark, d):
    words = table(spark, d, "labels").select(F.concat(F.lit("doc_"), "doc_id").alias("chunk_uid"), F.array(F.lit("the"), F.lit("idiot")).alias("keywords"))
    words = words.union(table(spark, d, "nation").select(F.concat(F.lit("none_"), "n_nationkey"), F.array(F.lit("x"))))
    return audit.critical(words, chunks(spark, d))


@query("j10_citation_edges", f"""WITH {LAW_CHUNKS}, t AS (SELECT law_tag, num, arg_max(chunk_uid, chunk_index) AS target FROM law_chunks GROUP BY ALL)
SELECT DISTINCT c.chunk_uid AS source_chunk_uid, t.target AS target_chunk_uid, 'menciona' AS relation_type FROM law_chunks c JOIN t ON t.law_tag = c.law_tag AND t.num = c.num + c.chunk_index - 1 WHERE c.chunk_uid <> t.target""")
def j10(spark, d):
    c = law_chunks(spark, d)
    return graph.citations_to_edges(c.select("chunk_uid", "law_tag", (F.col("num") + F.col("chunk_index") - 1).alias("num")), c)


@query("j15_labels_or_missing", """WITH u AS (SELECT DISTINCT l_partkey FROM lineitem) SELECT 'p_' || u.l_partkey AS uid, coalesce(p.p_name, '(not found)') AS label FROM u LEFT JOIN (SELECT * FROM part WHERE p_size > 10) p ON p.p_partkey = u.l_partkey""")
def j15(spark, d):
    names = table(spark, d, "part").filter("p_size > 10").select(F.concat(F.lit("p_"), "p_partkey").alias("uid"), "p_name")
    return graph.labels(edges(spark, d), names.withColumnRenamed("p_name", "label"))


# --- aggregations --------------------------------------------------------------------------------------------------

@query("a1_total", "SELECT count(*) AS chunks FROM documents")
def a1(spark, d):
    return audit.total(table(spark, d, "documents"), "chunks")


@query("a2_per_source", "SELECT source AS source_type, count(*) AS chunks FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src3', 'none') GROUP BY 1")
def a2(spark, d):
    return audit.per_value(table(spark, d, "documents").withColumnRenamed("source", "source_type"), "source_type", "chunks", ["src0", "src1", "src2", "src3", "none"])


@query("a3_relation_counts", f"WITH {EDGES} SELECT relation_type, count(*) AS edges FROM edges GROUP BY 1 ORDER BY edges DESC, relation_type")
def a3(spark, d):
    return audit.per_value(edges(spark, d), "relation_type", "edges").orderBy(F.desc("edges"), "relation_type")


_HITS = "hits AS (SELECT DISTINCT n_nationkey AS query_id, 's_' || s_suppkey AS uid FROM nation JOIN supplier ON s_nationkey = n_nationkey)"


def _hits(spark, d):
    s = table(spark, d, "supplier")
    return s.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("s_"), "s_suppkey").alias("uid")).distinct()


_VOTES = f"""{_NEAR}, {_HITS}, v AS (SELECT query_id, neighbour AS uid, count(DISTINCT h.uid) AS votes FROM hits h JOIN near n ON n.node = h.uid GROUP BY ALL),
top AS (SELECT query_id, uid, votes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, uid) AS n FROM v WHERE (query_id, uid) NOT IN (SELECT (query_id, uid) FROM hits)) WHERE n <= 5)"""


@query("a4_neighbour_votes", f"WITH {_VOTES} SELECT * FROM top")
def a4(spark, d):
    return graph.votes(edges(spark, d), _hits(spark, d))


@query("a6_split_articles", f"WITH {LAW_CHUNKS} SELECT law_tag, num, count(*) AS chunks, string_agg(chunk_uid, ',' ORDER BY chunk_uid) AS uids FROM law_chunks GROUP BY ALL HAVING count(*) > 2")
def a6(spark, d):
    return audit.split_articles(law_chunks(spark, d))


@query("a7_sources_with_edges", f"WITH {EDGES} SELECT relation_type, count(DISTINCT source_chunk_uid) AS sources FROM edges GROUP BY 1")
def a7(spark, d):
    return edges(spark, d).groupBy("relation_type").agg(F.count_distinct("source_chunk_uid").alias("sources"))


@query("a8_best_similarity", "SELECT l_suppkey AS query_id, l_partkey AS uid, max(l_discount) AS similarity FROM lineitem GROUP BY ALL")
def a8(spark, d):
    from ..operators.retrieval import best_per_uid

    return best_per_uid(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("uid"), F.col("l_discount").alias("similarity")))


_STRIPPED = r"regexp_replace(content, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')"
_FINAL = f"SELECT chunk_uid, length(content) < 200 AS too_short, length(content) > 4000 AS too_long, regexp_matches({_STRIPPED}, '^[a-záéíóúñ]') AS bad_start, NOT regexp_matches({_STRIPPED}, '[.;:!?)]$') AS bad_end FROM chunks"


@query("a9_audit_summary", f"""WITH {CHUNKS}, {EDGES}, f AS ({_FINAL}), k AS (SELECT 'p_' || p_partkey AS uid FROM part WHERE p_size <= 40 UNION SELECT 's_' || s_suppkey FROM supplier),
x AS (SELECT count(*) AS chunks, count_if(too_short OR bad_start) AS severe, count_if((too_long OR bad_end) AND NOT (too_short OR bad_start)) AS mild, (SELECT count(*) FROM edges) AS edges,
(SELECT count(*) FROM edges WHERE source_chunk_uid NOT IN (SELECT uid FROM k) OR target_chunk_uid NOT IN (SELECT uid FROM k)) AS broken FROM f)
SELECT *, CASE WHEN severe = 0 AND broken = 0 THEN 'ok' WHEN severe * 20 <= chunks THEN 'review' ELSE 'fail' END AS verdict FROM x""")
def a9(spark, d):
    return audit.summary(audit.final_flags(chunks(spark, d)), edges(spark, d), j6(spark, d))


# --- windows, sorting, sets ------------------------------------------------------------------------------------------

@query("w1_duplicate_uids", "SELECT doc_id, CASE WHEN n > 1 THEN uid || '_dup' || n ELSE uid END AS uid FROM (SELECT doc_id, sha256(text) AS uid, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents)")
def w1(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("uid"))
    return store.mark_duplicates(docs, "uid", F.col("doc_id"))


@query("w2_first_per_uid", "SELECT min(doc_id) AS doc_id, sha256(text) AS uid FROM documents GROUP BY 2")
def w2(spark, d):
    return store.first_per(table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("uid")), ["uid"], F.col("doc_id"))


@query("w3_article_gaps", f"""WITH a AS (SELECT DISTINCT law_tag, num FROM ({_ARTICLES})), g AS (SELECT *, lead(num) OVER (PARTITION BY law_tag ORDER BY num) AS next_num FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY law_tag ORDER BY num) AS n FROM g WHERE next_num - num > 5) SELECT law_tag, num, next_num, next_num - num - 1 AS missing FROM r WHERE n <= 5""")
def w3(spark, d):
    return audit.gaps(table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.concat(F.lit("law"), F.col("o_custkey") % 7).alias("law_tag"), F.col("o_orderkey").alias("num")))


@query("w4_precedence_edges", f"""WITH {LAW_CHUNKS}, e AS (SELECT law_tag, num, arg_max(chunk_uid, chunk_index) AS last, arg_min(chunk_uid, chunk_index) AS first FROM law_chunks GROUP BY ALL),
n AS (SELECT last AS source_chunk_uid, lead(first) OVER (PARTITION BY law_tag ORDER BY num) AS target_chunk_uid, 'precede_a' AS relation_type FROM e) SELECT * FROM n WHERE target_chunk_uid IS NOT NULL""")
def w4(spark, d):
    return graph.precedence(law_chunks(spark, d))


@query("w6_neighbour_cap", f"WITH {_NEAR} SELECT * FROM near")
def w6(spark, d):
    return graph.capped_neighbours(edges(spark, d), 5)


@query("w8_latest_row", "SELECT user_id AS chat_id, max(event_id) AS id FROM events GROUP BY 1")
def w8(spark, d):
    return store.first_per(query_log(spark, d).select("chat_id", "id"), ["chat_id"], F.desc("id"))


@query("o4_expansion_top", f"WITH {_VOTES} SELECT query_id, uid, votes FROM top WHERE (query_id, uid) IN (SELECT (query_id, uid) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, uid) AS k FROM top) WHERE k <= 3)")
def o4(spark, d):
    return graph.votes(edges(spark, d), _hits(spark, d), top=3)


@query("o5_audit_lists", f"""WITH {CHUNKS}, s AS (SELECT 'shortest' AS list, chunk_uid, length(content) AS chars FROM chunks ORDER BY length(content), chunk_uid LIMIT 20), l AS (SELECT 'longest' AS list, chunk_uid, length(content) AS chars FROM chunks ORDER BY length(content) DESC, chunk_uid LIMIT 15)
SELECT * FROM s UNION ALL SELECT * FROM l""")
def o5(spark, d):
    return audit.length_lists(chunks(spark, d), 20, 15)


@query("o6_natural_order", """SELECT article, law_tag, row_number() OVER (PARTITION BY law_tag ORDER BY num, letter, sub) AS place FROM (
SELECT 'l' || l_suppkey AS law_tag, l_orderkey || '_' || lower(l_returnflag) || '_' || l_linenumber AS article, l_orderkey AS num, lower(l_returnflag) AS letter, l_linenumber AS sub FROM lineitem)""")
def o6(spark, d):
    from ..functions.text import natural_key
    from ..operators.ordered import in_order

    lines = table(spark, d, "lineitem").select(F.concat(F.lit("l"), "l_suppkey").alias("law_tag"), F.concat_ws("_", "l_orderkey", F.lower("l_returnflag"), "l_linenumber").alias("article"))
    return in_order(lines, ["law_tag"], [natural_key(F.col("article"))], place="place").select("article", "law_tag", "place")


@query("o7_latest_queries", "SELECT event_id AS id, user_id AS chat_id, props AS query_text FROM events WHERE props <> '' ORDER BY ts DESC, event_id DESC LIMIT 50")
def o7(spark, d):
    return store.latest_queries(query_log(spark, d), 50).select("id", "chat_id", "query_text")


@query("u1_union_totals", "SELECT kind, count(*) AS rows_in FROM (SELECT 'documents' AS kind FROM documents UNION ALL SELECT 'pages' FROM pages UNION ALL SELECT 'conversations' FROM conversations) GROUP BY 1")
def u1(spark, d):
    return audit.union_totals({t: table(spark, d, t) for t in ("documents", "pages", "conversations")})


@query("u2_set_difference", "SELECT DISTINCT l_orderkey AS num FROM lineitem EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def u2(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("num")).distinct().exceptAll(table(spark, d, "orders").filter("o_orderstatus = 'O'").select("o_orderkey").distinct())


def _line_edges(spark, d):
    """An edge a line, repeated ones too."""
    return table(spark, d, "lineitem").select(F.concat(F.lit("p_"), "l_partkey").alias("source_chunk_uid"), F.concat(F.lit("s_"), "l_suppkey").alias("target_chunk_uid"), F.col("l_returnflag").alias("relation_type"))


@query("u3_distinct_edges", f"WITH {EDGES} SELECT source_chunk_uid, target_chunk_uid, relation_type FROM edges")
def u3(spark, d):
    return graph.merged(_line_edges(spark, d))


@query("u4_merged_edges", f"""WITH {EDGES}, {LAW_CHUNKS}, e AS (SELECT law_tag, num, arg_max(chunk_uid, chunk_index) AS last, arg_min(chunk_uid, chunk_index) AS first FROM law_chunks GROUP BY ALL),
n AS (SELECT last AS source_chunk_uid, lead(first) OVER (PARTITION BY law_tag ORDER BY num) AS target_chunk_uid, 'precede_a' AS relation_type FROM e)
SELECT source_chunk_uid, target_chunk_uid, relation_type FROM edges UNION SELECT * FROM n WHERE target_chunk_uid IS NOT NULL UNION SELECT 'r_' || n_regionkey, 'n_' || n_nationkey, 'regula' FROM nation""")
def u4(spark, d):
    seeds = table(spark, d, "nation").select(F.concat(F.lit("r_"), "n_regionkey").alias("source_chunk_uid"), F.concat(F.lit("n_"), "n_nationkey").alias("target_chunk_uid"), F.lit("regula").alias("relation_type"))
    return graph.merged(seeds, _line_edges(spark, d), w4(spark, d))


@query("t33_chunk_flags", f"""WITH {CHUNKS} SELECT chunk_uid, length(content) - length(replace(content, chr(65533), '')) AS bad_chars, regexp_matches({_STRIPPED}, '^[a-záéíóúñ]') AS starts_mid_word, regexp_matches({_STRIPPED}, '[a-záéíóúñ]$') AS ends_mid_word,
NOT regexp_matches({_STRIPPED}, '[.;:!?)]$') AS ends_mid_sentence, CASE WHEN length(content) < 500 THEN 'short' WHEN length(content) > 6000 THEN 'long' ELSE 'normal' END AS length_class, substr(content, 1, 100) AS first_100, right(content, 100) AS last_100 FROM chunks""")
def t33(spark, d):
    return audit.flags(chunks(spark, d)).withColumn("bad_chars", F.col("bad_chars").cast("long"))


@query("t34_final_flags", f"WITH {CHUNKS} {_FINAL}")
def t34(spark, d):
    return audit.final_flags(chunks(spark, d))


@query("v2_dimension_check", "SELECT vec_id, len(embedding) = 64 AS accepted FROM embeddings")
def v2(spark, d):
    from ..functions.vectors import has_dimension

    return table(spark, d, "embeddings").select("vec_id", has_dimension("embedding", 64).alias("accepted"))
