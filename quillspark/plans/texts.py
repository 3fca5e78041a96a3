"""Queries of the text functions and of segmentation, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import segment
from .tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def docs(spark, d, *more):
    return table(spark, d, "documents").select("doc_id", "text", *more)


_ACC = f"'{T.ACCENTED}', '{T.BASE}'"
_STRIP = lambda x: f"regexp_replace({x}, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g')"


@query("t1_normalise", f"SELECT doc_id, translate(lower(text), {_ACC}) AS plain FROM documents")
def t1(spark, d):
    return docs(spark, d).select("doc_id", T.normalise(F.col("text")).alias("plain"))


@query("t2_clean_lines", rf"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: NOT (contains(lower(s), 'licensed') OR contains(lower(s), 'idiot') OR regexp_matches({_STRIP('s')}, '^[0-9]+[.)]')
OR (length({_STRIP('s')}) < 40 AND (contains({_STRIP('s')}, 'Ley') OR contains({_STRIP('s')}, 'The'))))) AS l FROM documents)
SELECT doc_id, {_STRIP(r"regexp_replace(regexp_replace(array_to_string(l, chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g')")} AS clean FROM l""")
def t2(spark, d):
    return docs(spark, d).select("doc_id", T.clean_lines(F.col("text"), ["licensed", "idiot"], [r"^[0-9]+[.)]"], ["Ley", "The"]).alias("clean"))


@query("t3_sentences", r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \t\n\r]+([A-ZÁÉÍÓÚÜÑ])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM documents)
SELECT doc_id, len(s) AS n_sentences, s[1] AS first_sentence, s[-1] AS last_sentence FROM s""")
def t3(spark, d):
    s = T.sentences(F.col("text"))
    return docs(spark, d).select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.element_at("s", 1).alias("first_sentence"), F.element_at("s", -1).alias("last_sentence"))


@query("t4_sentence_packing")
def t4(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(T.chunk_sentences(F.col("text"))).alias("part", "content"))


@query("t5_sliding_split")
def t5(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(T.sliding()(F.col("text"))).alias("part", "content"))


@query("t6_halve", f"""WITH h AS (SELECT doc_id, text, length(text) // 2 AS mid, instr(substr(text, length(text) // 2 - 199), chr(10)) AS f FROM documents), a AS (SELECT *, CASE WHEN f > 0 THEN mid - 200 + f - 1 ELSE mid END AS cut_at FROM h)
SELECT doc_id, CASE WHEN length(text) <= 4000 THEN text ELSE {_STRIP('substr(text, 1, cut_at)')} END AS first_half, CASE WHEN length(text) <= 4000 THEN '' ELSE {_STRIP('substr(text, cut_at + 1)')} END AS second_half FROM a""")
def t6(spark, d):
    h = docs(spark, d).select("doc_id", T.halve(F.col("text"), joint="\n").alias("h"))
    return h.select("doc_id", F.element_at("h", 1).alias("first_half"), F.when(F.size("h") > 1, F.get("h", F.lit(1))).otherwise("").alias("second_half"))


def _cut_sql(seps: list[str], limit: int) -> str:
    cases = ""
    for s in seps:
        lit = " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in s)
        rev = " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in reversed(s))
        last = f"({limit} - instr(reverse(head), {rev}) - {len(s)} + 1)"
        cases += f"WHEN instr(head, {lit}) > 0 AND {last} > {limit} * 0.7 THEN " + _STRIP(f"substr(head, 1, {last} + {len(s)})") + " "
    return f"WITH h AS (SELECT doc_id, text, substr(text, 1, {limit}) AS head FROM documents) SELECT doc_id, CASE WHEN length(text) <= {limit} THEN text {cases} ELSE {_STRIP('head')} END AS cut FROM h"


@query("t7_truncate", _cut_sql(["\n\n", ". ", ".\n", "; ", ": ", "\n", " "], 2000))
def t7(spark, d):
    return docs(spark, d).select("doc_id", T.truncate(F.col("text"), 2000).alias("cut"))


@query("t8_content_hash", "SELECT doc_id, sha256(text) AS full_hash, substr(sha256(text), 1, 32) AS short_hash FROM documents")
def t8(spark, d):
    return docs(spark, d).select("doc_id", F.sha2("text", 256).alias("full_hash"), F.left(F.sha2("text", 256), F.lit(32)).alias("short_hash"))


_RECORD = "'## Metadata' || chr(10) || '- id: d' || doc_id || chr(10) || '- lang:' || coalesce(lang, '') || chr(10) || '- estado: ' || CASE WHEN doc_id % 3 = 0 THEN 'derogada' ELSE 'vigente' END || chr(10) || chr(10) || '## Resumen' || chr(10) || CASE WHEN doc_id % 5 = 0 THEN '.' ELSE coalesce(source, '') END || chr(10) || chr(10) || '## Contenido' || chr(10) || replace(text, '## ', '') || chr(10) || chr(10) || '## Fuente' || chr(10) || 'x'"


def markdown_of(spark, d):
    """Markdown records composed from documents."""
    meta = F.concat(F.lit("## Metadata\n- id: d"), "doc_id", F.lit("\n- lang:"), F.coalesce("lang", F.lit("")), F.lit("\n- estado: "), F.when(F.col("doc_id") % 3 == 0, "derogada").otherwise("vigente"))
    body = F.concat(F.lit("\n\n## Resumen\n"), F.when(F.col("doc_id") % 5 == 0, ".").otherwise(F.coalesce("source", F.lit(""))), F.lit("\n\n## Contenido\n"), F.replace("text", F.lit("## "), F.lit("")), F.lit("\n\n## Fuente\nx"))
    return table(spark, d, "documents").select("doc_id", "lang", "source", "text", F.concat(meta, body).alias("record"))


@query("t9_metadata_map", "SELECT doc_id, 'd' || doc_id AS id, coalesce(lang, '') AS lang, CASE WHEN doc_id % 3 = 0 THEN 'derogada' ELSE 'vigente' END AS estado, 3 AS keys FROM documents")
def t9(spark, d):
    m = markdown_of(spark, d).select("doc_id", T.metadata_map(F.col("record")).alias("m"))
    return m.select("doc_id", F.col("m")["id"].alias("id"), F.col("m")["lang"].alias("lang"), F.col("m")["estado"].alias("estado"), F.size("m").alias("keys"))


@query("t10_sections", f"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR source IS NULL THEN '' ELSE 'Resumen:' || chr(10) || source || chr(10) || chr(10) END || 'Contenido:' || chr(10) || {_STRIP("replace(text, '## ', '')")} AS body FROM documents WHERE {_STRIP('text')} NOT IN ('', '.')""")
def t10(spark, d):
    return markdown_of(spark, d).select("doc_id", T.record_text(F.col("record")).alias("body")).filter("body is not null")


@query("t11_law_from_code", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'lir' WHEN 2 THEN 'codigo_tributario' WHEN 3 THEN 'iva' ELSE 'codigo_tributario' END AS law_tag FROM orders")
def t11(spark, d):
    codes = F.create_map(*map(F.lit, [1, "lir", 2, "codigo_tributario", 3, "iva"]))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(codes[(F.col("o_orderkey") % 4).cast("int")], F.lit("codigo_tributario")).alias("law_tag"))


@query("t12_law_from_name", "SELECT page_id, CASE WHEN contains(lower(url), '/de/') THEN 'law_de' WHEN contains(lower(url), '/es/') OR contains(lower(url), '/fr/') THEN 'law_romance' ELSE 'ley' END AS law_tag FROM pages")
def t12(spark, d):
    return table(spark, d, "pages").select("page_id", T.first_match(F.col("url"), [("law_de", ["/de/"]), ("law_romance", ["/es/", "/fr/"])], "ley").alias("law_tag"))


@query("t13_law_from_content", "SELECT doc_id, CASE WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'lowei') THEN 'a' WHEN contains(lower(text), 'license') THEN 'b' END AS law_tag FROM documents")
def t13(spark, d):
    return docs(spark, d).select("doc_id", T.first_match(F.col("text"), [("a", ["idiot", "lowei"]), ("b", ["license"])]).alias("law_tag"))


@query("t14_record", "SELECT doc_id, 'ruling_d' || doc_id AS chunk_uid, coalesce(lang, '') || '/d' || doc_id AS hierarchy_path, doc_id % 3 = 0 AS is_derogada FROM documents")
def t14(spark, d):
    m = markdown_of(spark, d).select("doc_id", T.metadata_map(F.col("record")).alias("m"))
    ident = F.coalesce(F.col("m")["id"], F.lit("unknown"))
    return m.select("doc_id", F.concat(F.lit("ruling_"), ident).alias("chunk_uid"), F.concat_ws("/", F.col("m")["lang"], ident).alias("hierarchy_path"), F.lower(F.col("m")["estado"]).isin("derogada", "revocada").alias("is_derogada"))


def _laws(spark, d):
    """Every line of a document as an article of a law."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("ARTICULO "), (i + 1).cast("string"), F.lit(".- "), x))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("law"), "doc_id").alias("law_tag"), F.concat(F.lit("Preface\n"), F.array_join(lines, "\n")).alias("text"))


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)"


@query("t15_articles", f"WITH {_LINES} SELECT doc_id, k::VARCHAR AS ident, {_STRIP("'ARTICULO ' || k || '.- ' || line")} AS article FROM l")
def t15(spark, d):
    return segment.articles(_laws(spark, d)).select("doc_id", "ident", "article")


@query("w5_article_spans", f"""WITH {_LINES}, s AS (SELECT doc_id, k, length('ARTICULO ' || k || '.- ' || line) + CASE WHEN k = max(k) OVER (PARTITION BY doc_id) THEN 0 ELSE 1 END AS n FROM l)
SELECT doc_id, k::VARCHAR AS ident, (8 + coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS begin_at, (8 + sum(n) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING))::INT AS end_at FROM s""")
def w5(spark, d):
    s = _laws(spark, d).select("doc_id", F.explode(segment.spans(F.col("text"), segment.LAW.article)).alias("s"))
    return s.select("doc_id", "s.ident", F.col("s.begin").alias("begin_at"), F.col("s.end").alias("end_at"))


@query("w7_close_starts", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'A1.- x A2.- y and text. ' ELSE 'A1.- x and text. ' END AS first_piece, length('A3.- ' || text)::BIGINT AS rest, 2 AS pieces FROM documents")
def w7(spark, d):
    """In every second document a start stands seven characters after another: it is none."""
    short = F.when(F.col("doc_id") % 2 == 0, "A1.- x A2.- y").otherwise("A1.- x")
    parts = segment.merge_close(segment.pieces(F.concat(short, F.lit(" and text. A3.- "), "text"), r"A([0-9])\.-"))
    return docs(spark, d).select("doc_id", parts.alias("p")).select("doc_id", F.col("p")[0].alias("first_piece"), F.length(F.col("p")[1]).cast("long").alias("rest"), F.size("p").alias("pieces"))


@query("t16_transitory", "SELECT doc_id, length(text) AS main_chars, CASE WHEN doc_id % 2 = 0 THEN length(text) + 28 ELSE 0 END AS late_chars FROM documents")
def t16(spark, d):
    body = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\nDISPOSICIONES TRANSITORIAS\n"), "text")).otherwise(F.col("text"))
    main, late = segment.split_transitory(body, segment.LAW.transitory)
    return docs(spark, d).select("doc_id", F.length(main).cast("long").alias("main_chars"), F.length(late).cast("long").alias("late_chars"))


def _nested(spark, d):
    """Documents as one article of two numerals, the first with three letters."""
    text = F.concat(F.lit("ARTICULO 7.- intro\n 1° one\n a) "), "text", F.lit("\n b) bb\n c) cc\n 2° two"))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("law"), "doc_id").alias("law_tag"), text.alias("text"))


@query("t17_children", "SELECT doc_id, u.path FROM documents, (VALUES ('n1_a'), ('n1_b'), ('n1_c'), ('n2')) u(path)")
def t17(spark, d):
    return segment.articles(_nested(spark, d)).select("doc_id", F.explode(segment.children(F.col("article"), segment.LAW)).alias("c")).select("doc_id", "c.path")


@query("t18_law_chunks")
def t18(spark, d):
    return segment.law_chunks(_laws(spark, d)).select("doc_id", "chunk_uid", "hierarchy_path", "section_level_name", "chunk_index", "total_chunks", "content", "content_hash")


@query("t19_whole_law", "SELECT doc_id, 'ley_law' || doc_id || '_full' AS chunk_uid, substr(text, 1, 10000) AS content, substr(sha256(text), 1, 32) AS content_hash FROM documents WHERE NOT regexp_matches(text, '(ART[IÍ]CULO|Art[ií]culo) +[0-9]')")
def t19(spark, d):
    laws = table(spark, d, "documents").filter("NOT text rlike '(ART[IÍ]CULO|Art[ií]culo) +[0-9]'").select("doc_id", F.concat(F.lit("law"), "doc_id").alias("law_tag"), "text")
    return segment.law_chunks(laws).select("doc_id", "chunk_uid", "content", "content_hash")


@query("t20_one_article", f"WITH {_LINES} SELECT doc_id, {_STRIP("'ARTICULO 2.- ' || line")} AS article FROM l WHERE k = 2")
def t20(spark, d):
    return segment.one_article(_laws(spark, d), "2")


@query("t21_numbers", r"""WITH m AS (SELECT doc_id, list_sort(list_distinct([regexp_extract(m, '[0-9]+')::BIGINT FOR m IN regexp_extract_all(text, '[ \n][0-9]{1,9}\b')])) AS m FROM documents)
SELECT doc_id, array_to_string(m, ',') AS numbers FROM m""")
def t21(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(T.numbers(F.col("text")).cast("array<string>"), ",").alias("numbers"))


@query("t22_lettered_sections", f"SELECT doc_id, u.letter, CASE u.letter WHEN 'A' THEN 'A) ' || {_STRIP("replace(replace(text, chr(10), ' '), 'BIS', '')")} WHEN 'B' THEN 'B) second' ELSE 'C) third' END AS section FROM documents, (VALUES ('A'), ('B'), ('C')) u(letter) WHERE {_STRIP('text')} <> ''")
def t22(spark, d):
    text = F.concat(F.lit("A) "), F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("BIS"), F.lit("")), F.lit("\nB) second\nBIS skipped\nC) third"))
    s = docs(spark, d).filter(T.strip(F.col("text")) != "").select("doc_id", F.explode(segment.lettered_sections(text)).alias("s"))
    return s.select("doc_id", "s.letter", F.regexp_replace("s.text", r"^([A-E]\)) +", "$1 ").alias("section"))


@query("t23_anchored_passage")
def t23(spark, d):
    text = F.concat(F.lit("START one "), "text", F.lit(" START two ANCHOR "), "text", F.lit(" END"))
    return docs(spark, d).select("doc_id", segment.anchored("ANCHOR", "START", "END", least=100)(text).alias("passage"))


@query("t24_sections_by_line", """WITH l AS (SELECT doc_id, unnest(string_split('intro' || chr(10) || 'A) title one' || chr(10) || text || chr(10) || 'B) title two' || chr(10) || 'end', chr(10))) AS line, generate_subscripts(string_split('intro' || chr(10) || 'A) title one' || chr(10) || text || chr(10) || 'B) title two' || chr(10) || 'end', chr(10)), 1) AS k FROM documents),
s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[A-E]\\)') AND contains(lower(line), 'title') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS section FROM l)
SELECT doc_id, section::BIGINT AS section, CASE WHEN section > 0 THEN substr(arg_min(line, k), 1, 1) END AS letter FROM s GROUP BY doc_id, section""".replace("\\\\)", "\\)"))
def t24(spark, d):
    text = F.concat(F.lit("intro\nA) title one\n"), "text", F.lit("\nB) title two\nend"))
    s = segment.sections_by_line(docs(spark, d).select("doc_id", text.alias("text")), "doc_id", "text", ["title"])
    return s.select("doc_id", F.col("section").cast("long").alias("section"), "letter")


@query("t25_cited_articles", r"""SELECT doc_id, array_to_string([replace(replace(lower(m), '°', ''), 'º', '') FOR m IN regexp_extract_all('el artículo ' || doc_id || '° y Articulo 12bis ' || text, '(?i)art[íi]culo\s+(\d+[°0-9A-Za-z_]*)', 1)], ',') AS articles FROM documents""")
def t25(spark, d):
    text = F.concat(F.lit("el artículo "), "doc_id", F.lit("° y Articulo 12bis "), "text")
    return docs(spark, d).select("doc_id", F.array_join(T.cited_articles(text), ",").alias("articles"))


@query("t27_article_label", "SELECT l_orderkey, l_linenumber, 'Art. ' || l_orderkey || ' ' || l_linenumber AS label FROM lineitem")
def t27(spark, d):
    uid = F.concat_ws("_", F.lit("ley_x_art"), "l_orderkey", "l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.article_label(uid).alias("label"))


@query("t28_article_key", "SELECT l_orderkey || '_' || l_linenumber AS article_key, l_orderkey AS num FROM lineitem")
def t28(spark, d):
    uid = F.concat_ws("_", F.lit("ley_x_art"), "l_orderkey", "l_linenumber")
    return table(spark, d, "lineitem").select(T.article_key(uid).alias("article_key"), T.article_number(uid).alias("num"))


@query("t29_citations", "SELECT doc_id, u.num, u.law_tag FROM documents, LATERAL (VALUES (doc_id, NULL), (doc_id + 1000000, 'lir'), (doc_id + 2000000, 'iva')) u(num, law_tag)")
def t29(spark, d):
    text = F.concat(F.lit("ver artículo "), "doc_id", F.lit(" de esta ley; art. "), F.col("doc_id") + 1000000, F.lit(" de la ley de la renta; artículo "), F.col("doc_id") + 2000000, F.lit(" de la ley del iva; art. "), "doc_id", F.lit(" de la ley de la renta. "), F.lit("x" * 120), "text")
    return docs(spark, d).select("doc_id", F.explode(segment.citations(text, [("renta", "lir"), ("iva", "iva")])).alias("c")).select("doc_id", "c.num", "c.law_tag")


@query("t35_normalise_article", "SELECT o_orderkey, o_orderkey || 'bis' AS num FROM orders")
def t35(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.normalise_article(F.concat(F.lit(" "), "o_orderkey", F.lit("BIS°.- "))).alias("num"))


@query("t41_extraction_json", """SELECT event_id, 'e' || event_id AS source, 'u' || user_id AS target, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'relacionado_con' END AS type, CASE WHEN event_id % 5 = 0 THEN 0.5 ELSE 0.8 END AS confidence FROM events WHERE event_id % 3 <> 2""")
def t41(spark, d):
    kind = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(', "type": "'), "event_type", F.lit('"'))).otherwise("")
    sure = F.when(F.col("event_id") % 5 == 0, ', "confidence": 0.5').otherwise("")
    item = F.concat(F.lit('{"relations": [{"source": "e'), "event_id", F.lit('", "target": "u'), "user_id", F.lit('"'), kind, sure, F.lit('}, {"source": "", "target": "x"}]}'))
    answer = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), item, F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("ok "), F.translate(item, '"', "“"), F.lit(" end"))).otherwise("no json")
    return table(spark, d, "events").select("event_id", F.explode(T.relations(answer)).alias("r")).select("event_id", "r.source", "r.target", "r.type", "r.confidence")


@query("t42_facts_json", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events")
def t42(spark, d):
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("json "), "props")).when(F.col("event_id") % 4 == 2, F.col("props")).otherwise("[1, 2]")
    return table(spark, d, "events").select("event_id", T.facts(text)["k"].alias("k"))


@query("t43_content_type", f"""WITH p AS (SELECT conv_id, turn, lower({_STRIP('text')}) AS p FROM conversations)
SELECT conv_id, turn, CASE WHEN length(p) < 40 OR regexp_matches(p, '^(the|hola)') THEN 'conversacion' WHEN contains(p, 'idiot') OR contains(p, 'tionth') THEN 'guion' WHEN contains(p, 'heree') THEN 'manual'
WHEN regexp_matches(p, '^(que |is )') AND length(p) < 120 THEN 'conversacion' ELSE 'articulo' END AS kind FROM p""")
def t43(spark, d):
    kind = T.content_type(F.col("text"), ["the", "hola"], [("guion", ["idiot", "tionth"]), ("manual", ["heree"])], ["que ", "is "])
    return table(spark, d, "conversations").select("conv_id", "turn", kind.alias("kind"))


@query("t44_paragraph_packing")
def t44(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("part", "content"))


@query("t45_strip_refs", rf"""SELECT conv_id, turn, {_STRIP(r"regexp_replace(regexp_replace(regexp_replace(text || ' [1, 2] . end [3]', '\[[0-9]+(, ?[0-9]+)*\]', '', 'g'), '[ ]{2,}', ' ', 'g'), ' ([.,;:])', '\1', 'g')")} AS plain FROM conversations""")
def t45(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.strip_refs(F.concat("text", F.lit(" [1, 2] . end [3]"))).alias("plain"))


@query("t46_slug", r"""SELECT doc_id, CASE WHEN s = '' THEN 'documento' ELSE s END AS slug FROM
(SELECT doc_id, regexp_replace(regexp_replace(strip_accents(lang || ' -' || upper(source) || '- ' || text), '[^a-zA-Z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM documents)""")
def t46(spark, d):
    name = F.concat("lang", F.lit(" -"), F.upper("source"), F.lit("- "), "text")
    return docs(spark, d, "lang", "source").select("doc_id", T.slug(name).alias("slug"))


@query("t47_live_lines", "SELECT page_id, 'Resultados en vivo:' || chr(10) || '- page ' || page_id || ' (' || url || '): ' || substr(html, 1, 500) AS lines FROM pages")
def t47(spark, d):
    one = F.array(F.struct(F.concat(F.lit("page "), "page_id").alias("title"), "url", F.col("html").alias("content")))
    return table(spark, d, "pages").select("page_id", T.live_lines(one).alias("lines"))
