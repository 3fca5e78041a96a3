"""Pattern sets and one-pass cutting against the column expressions and plain search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import guardrail, pattern_set, segment
from quillspark.operators.pattern_set import PatternSet, required_literal

PATTERNS = [r"Art[íi]culo ([0-9]+) de la ley de la [a-z]+", r"(?i)art\. ([0-9]+) del dl-82[45]", r"DL-82[45]", r"[0-9]{3,}", r"(?:ley|norma) n[°º] ?([0-9]+)"]
NAMES = [("renta", "lir"), ("dl-824", "lir"), ("dl-825", "iva")]


def test_required_literals():
    assert required_literal(r"Art[íi]culo ([0-9]+) de la ley de la [a-z]+") == " de la ley de la "
    assert required_literal(r"DL-82[45]") == "dl-82"
    assert required_literal(r"(a|b)?x*") == "" and required_literal("[ab]|cd") == "" and required_literal("(?:ab)+c") == "ab"


@pytest.mark.parametrize("few", [pattern_set.FEW, 0])  # one by one, in an automaton
def test_sets_find_what_each_pattern_finds(monkeypatch, few):
    monkeypatch.setattr(pattern_set, "FEW", few)
    draw = random.Random(4)
    bits = ["Artículo 12 de la ley de la renta", "ART. 7 del DL-825", "DL-824", "1234", "ley n° 5", "norma nº9", "texto ", "\n", "Articulo 3 de la ley", "ß İ"]
    found = PatternSet(PATTERNS)
    for _ in range(300):
        text = " ".join(draw.choices(bits, k=draw.randrange(0, 8)))
        assert [(i, m.span()) for i, m in found.matches(text)] == [(i, m.span()) for i, p in enumerate(PATTERNS) for m in re.finditer(p, text, re.ASCII)]


def test_verify_equals_the_expressions(spark):
    draw = random.Random(5)
    bits = ["Artículo 12 de la ley de la renta", "Art. 7 del DL-825", "DL-824", "DL-825", "y", "ley_lir_art_12_b x", "ley_iva_art_7", "ARTÍCULO: Art. 7.", "artículo 12°", "Artículo 77"]
    text = lambda: draw.choice([None, "", " ".join(draw.choices(bits, k=draw.randrange(1, 7)))])
    answers = spark.createDataFrame([(i, text(), text()) for i in range(400)], "id long, answer string, context string")
    columns = ["id", "citation", "num", "place", "law_tag", "found"]
    expressed = guardrail.verified(guardrail.citations(answers, PATTERNS[:1] + PATTERNS[2:3]), NAMES).withColumn("found", F.coalesce("found", F.lit(False)))
    got = guardrail.verify(answers, PATTERNS[:1] + PATTERNS[2:3], NAMES)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(map(tuple, expressed.select(*columns).collect()), key=repr)
    assert not any(r["found"] for r in guardrail.verify(answers.drop("context"), PATTERNS, NAMES, context=None).collect())


def test_leaves_equal_the_expression_and_spans_tile(spark):
    draw = random.Random(6)
    bits = ["\n 1° uno", "\n2º dos", "\n a) aa", "\n b) bb", "\n ñ) cc", " texto", "\n", " x) no", "\n3 ° tres"]
    texts = ["ARTICULO 7.- " + "".join(draw.choices(bits, k=draw.randrange(0, 9))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    expressed = {r["i"]: [(c["path"], c["text"]) for c in r["c"]] for r in df.select("i", segment.children(F.col("text"), segment.LAW).alias("c")).collect()}
    cutter = segment.Cutter(segment.LAW)
    assert {i: cutter.leaves(t) for i, t in enumerate(texts)} == expressed
    law = "intro " + "".join(f"Artículo {n}.- cuerpo {n} " for n in range(1, 30)) + "Art. \nDISPOSICIONES TRANSITORIAS\nARTICULO 1°.- a ARTICULO 2.-"
    spans = cutter.articles(law)
    assert [s[0] for s in spans] == [*(str(n) for n in range(1, 30)), "trans_1", "trans_2"]
    assert all(a[2] == b[1] for a, b in zip(spans[:28], spans[1:29])) and spans[-1][2] == len(law)


def test_laws_with_and_without_articles(spark):
    docs = spark.createDataFrame([(1, "lir", "ARTICULO 1.- uno\n 1° a\n 2° b"), (2, "iva", "nada " * 3000), (3, "iva", None), (4, "iva", "")], "doc_id long, law_tag string, text string")
    got = {r["chunk_uid"]: r for r in segment.law_chunks(docs).collect()}
    assert set(got) == {"ley_lir_art_1_n1", "ley_lir_art_1_n2", "ley_iva_full", "ley_iva_full_dup2"}
    assert len(got["ley_iva_full"]["content"]) == 10_000 and got["ley_iva_full"]["hierarchy_path"] == ""


def test_rules_fire_as_read(spark):
    from quillspark.operators import retrieval

    rules = [(1, [["the", "a"], ["tion"]], ["zz"], ["u1"]), (2, [], [], ["u2"]), (3, [[""], ["of"]], None or [], ["u1", "u3"]), (4, [["of"]], [""], ["u2"]), (5, [[], ["of"]], [], ["u3"])]
    queries = [(1, "The nation of"), (2, "zz a tion"), (3, "of"), (4, None), (5, "")]
    fires = lambda t, all_of, none_of: all(any(w in t for w in g) for g in all_of) and not any(w in t for w in none_of)
    expected = {(q, u) for q, t in queries for _, all_of, none_of, uids in rules if fires((t or "").lower(), all_of, none_of) for u in uids}
    df = spark.createDataFrame(rules, "rule_id int, all_of array<array<string>>, none_of array<string>, uids array<string>")
    chunks = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "uid string")
    got = {(r["query_id"], r["uid"]) for r in retrieval.forced_hits(spark.createDataFrame(queries, "query_id long, text string"), df, chunks).collect()}
    assert got == expected
    notes = spark.createDataFrame([(1, ["nation", "zz"], "n1"), (2, ["of"], "n2"), (3, ["missing"], "n3")], "note_id int, any_of array<string>, note string")
    told = {r["query_id"]: r["notes"] for r in retrieval.notes_for(spark.createDataFrame(queries, "query_id long, text string"), notes).collect()}
    assert told == {1: ["n1", "n2"], 2: ["n1"], 3: ["n2"]}
