"""Text functions and segmentation on small golden rows."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import segment

LAW = "Preface\nARTICULO 1.- Primero.\nArtículo 2.- intro\n 1° uno\n a) alfa\n b) beta\n 2° dos\nARTICULO 3.- tres\nDISPOSICIONES TRANSITORIAS\nARTICULO 1.- tarde"


def test_articles_and_children(spark):
    docs = spark.createDataFrame([(1, "lir", LAW), (2, "iva", "no article")], "doc_id long, law_tag string, text string")
    uids = [r.chunk_uid for r in segment.law_chunks(docs).orderBy("doc_id", "place", "leaf_no").collect()]
    assert uids == ["ley_lir_art_1", "ley_lir_art_2_n1_a", "ley_lir_art_2_n1_b", "ley_lir_art_2_n2", "ley_lir_art_3", "ley_lir_art_trans_1", "ley_iva_full"]


def test_truncate_and_halve(spark):
    df = spark.createDataFrame([("one. two three. four",), ("short",), (None,)], "text string")
    assert [r[0] for r in df.select(T.truncate(F.col("text"), 16, share=0.2)).collect()] == ["one. two three.", "short", None]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abc", min_size=1, max_size=9), min_size=1, max_size=12))
def test_packing_keeps_all(spark, parts):
    packed = spark.createDataFrame([(parts,)], "p array<string>").select(T.pack(F.col("p"), 12)).first()[0]
    assert " ".join(packed) == " ".join(parts)
    assert all(len(x) <= 12 for x in packed)


def test_relations(spark):
    text = 'x ```json\n{"relations": [{"source": "a", "target": "b"}, {"source": "a"}]}\n```'
    got = spark.createDataFrame([(text,), ("{broken",), (None,)], "t string").select(T.relations(F.col("t")).alias("r")).collect()
    assert [len(r.r) for r in got] == [1, 0, 0]
    assert (got[0].r[0].type, got[0].r[0].confidence) == ("relacionado_con", 0.8)


def test_close_starts(spark):
    """A start fewer than ten characters after the one before belongs to it, as in a line of references."""
    text = "A1.- x A2.- y and more text than that. A3.- short A4.- once more, far enough from others. A5.- end"
    got = spark.createDataFrame([(text,)], "text string").select(segment.merge_close(segment.pieces(F.col("text"), r"A([0-9])\.-")).alias("p")).first().p
    assert got == ["A1.- x A2.- y and more text than that. ", "A3.- short ", "A4.- once more, far enough from others. ", "A5.- end"]
    assert got[0].startswith("A1.- x A2.-")


def test_children_of_articles(spark):
    cases = {
        "Artículo 1.- intro\n 1° uno\n a) alfa\n b) beta\n 2° dos": ["n1_a", "n1_b", "n2"],
        "Artículo 1.- intro\n a) alfa\n b) beta\n c) gama": ["a", "b", "c"],
        "Artículo 1.- intro\n 1° only one\n a) and one letter": [""],
        "Artículo 1.- plain text, 2° inside a line and a) as well": [""],
        "Artículo 1.- intro\n 1° uno\n 2° dos\n a) one letter only\n 3° tres": ["n1", "n2", "n3"],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "k long, text string").select("k", F.transform(segment.children(F.col("text"), segment.LAW), lambda c: c["path"]).alias("paths"))
    assert [r.paths for r in df.orderBy("k").collect()] == list(cases.values())


def test_banned_concepts(spark):
    from quillspark.operators import guardrail

    patterns = [("(?i)vivienda habitual.*exenta", "one"), ("(?i)plazo mínimo", "two")]
    rows = ["La VIVIENDA habitual está exenta", "hay un Plazo Mínimo y la vivienda habitual exenta", "nada de eso", None]
    df = spark.createDataFrame(list(enumerate(rows)), "k long, text string").select("k", guardrail.banned(F.col("text"), patterns).alias("m"))
    assert [r.m for r in df.orderBy("k").collect()] == [["one"], ["one", "two"], [], []]
