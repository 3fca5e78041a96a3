"""Operators that SQL can't express, restated in plain Python from their definitions, on all documents of a table."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import segment
from quillspark.plans import registry
from quillspark.streaming import streams
from tests.conftest import SF

BIG = SF.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text").collect()}


def parts_of(spark, name):
    got = {}
    for r in registry.queries()[name](spark, BIG).collect():
        got.setdefault(r.doc_id, []).append((r.part, r.content))
    return {d: [c for _, c in sorted(p)] for d, p in got.items()}


def greedy(parts, limit, joint):
    done, now = [], ""
    for p in parts:
        if now and len(now) + len(p) + len(joint) > limit:
            done.append(now)
            now = p
        else:
            now = p if not now else now + joint + p
    return [*done, now] if now else done


def by_sentences(text, limit=3500):
    return [text] if len(text) <= limit else greedy(re.split(r"(?<=[.!?])[ \t\n\r]+(?=[A-ZÁÉÍÓÚÜÑ])", text), limit, " ")


def test_sentence_packing(spark, texts):
    assert parts_of(spark, "t4_sentence_packing") == {d: by_sentences(t) for d, t in texts.items()}


def test_sliding_split(spark, texts):
    want = {}
    for d, t in texts.items():
        out, at = [], 0
        while len(t) > 8000 and at + 8000 < len(t):
            newline = t.rfind("\n", at, at + 8000)
            end = newline + 1 if newline - at > 5600 else at + 8000
            out.append(t[at:end])
            at = end - 500
        want[d] = [*out, t[at:]]
    assert parts_of(spark, "t5_sliding_split") == want


def test_paragraph_packing(spark, texts):
    want = {}
    for d, t in texts.items():
        pieces = [x for p in t.split("\n\n") for x in (greedy(p.split("\n"), 4000, "\n") if len(p) > 4000 else [p])]
        want[d] = [t] if len(t) <= 4000 else [p.strip(" \t\n\r\f\v") for p in greedy(pieces, 4000, "\n\n")]
    assert parts_of(spark, "t44_paragraph_packing") == want


def test_law_chunks(spark, texts):
    want = set()
    for d, t in texts.items():
        for k, line in enumerate(t.split("\n"), 1):
            found = by_sentences(f"ARTICULO {k}.- {line}".strip(" \t\n\r\f\v"))
            for i, c in enumerate(found):
                uid = f"ley_law{d}_art_{k}" + (f"_{i}" if i else "")
                want.add((uid, f"articulo_{k}", f"ARTICULO {k} LAW{d}", i, len(found), c, hashlib.sha256(c.encode()).hexdigest()[:32]))
    got = registry.queries()["t18_law_chunks"](spark, BIG).collect()
    assert {(r.chunk_uid, r.hierarchy_path, r.section_level_name, r.chunk_index, r.total_chunks, r.content, r.content_hash) for r in got} == want and len(got) == len(want)


def test_levels_of_chunks(spark):
    law = "ARTICULO 2.- intro\n 1° uno\n a) alfa\n b) beta\n 2° dos\nARTICULO 3.- tres\n a) x\n b) y"
    rows = segment.law_chunks(spark.createDataFrame([(1, "lir", law)], "doc_id long, law_tag string, text string")).collect()
    assert {(r.hierarchy_path, r.section_level_name) for r in rows} == {
        ("articulo_2/numeral_1/letra_a", "ARTICULO 2 NUMERAL 1 LETRA a LIR"), ("articulo_2/numeral_1/letra_b", "ARTICULO 2 NUMERAL 1 LETRA b LIR"), ("articulo_2/numeral_2", "ARTICULO 2 NUMERAL 2 LIR"),
        ("articulo_3/letra_a", "ARTICULO 3 LETRA a LIR"), ("articulo_3/letra_b", "ARTICULO 3 LETRA b LIR"),
    }


def test_anchored_passage(spark, texts):
    got = {r.doc_id: r.passage for r in registry.queries()["t23_anchored_passage"](spark, BIG).collect()}
    for d, t in texts.items():
        whole = f"START one {t} START two ANCHOR {t} END"
        anchor = whole.index("ANCHOR")
        begin = whole.rindex("START", 0, anchor)
        stops = [m.start() for m in re.finditer("END", whole) if m.start() >= begin + 100]
        stops = [s for s in stops if not all(n in whole[max(0, s - 200) : s] for n in ("NOTA", "Ley"))]
        assert got[d] == whole[begin : stops[0] if stops else len(whole)].strip()


def test_batch_embedding(spark, texts):
    cut = {r.doc_id: r.t for r in spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", __import__("quillspark.functions.text", fromlist=["truncate"]).truncate(F.col("text")).alias("t")).collect()}
    for r in registry.queries()["v1_batch_embedding"](spark, BIG).collect():
        want = np.zeros(64)
        for w in cut[r.doc_id].split():
            h = zlib.crc32(w.encode())
            want[h % 64] += 1 if h & 0x10000 else -1
        assert (r.embedding is None and not cut[r.doc_id]) or list(r.embedding) == list(want)


def test_pending_cases_over_two_batches(spark, tmp_path):
    """State lives on from one batch to the next, and numbers choose among the branches asked for last."""
    schema = "chat_id long, ts timestamp, kind string, fact string, branches array<string>"
    at = lambda n: f"2024-01-01 00:00:0{n}"
    first = [(1, at(0), "answer", "2", None), (1, at(1), "pending", None, ["yes", "no"]), (1, at(2), "answer", "2", None), (2, at(0), "answer", "free text", None)]
    second = [(1, at(3), "answer", "1", None), (1, at(4), "answer", "3", None), (1, at(5), "result", None, None), (1, at(6), "answer", "1", None), (1, at(7), "topic", None, None), (2, at(3), "result", None, None)]
    for k, rows in enumerate((first, second)):
        data = spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))
        data.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.pending_cases(stream, str(tmp_path / "out"), str(tmp_path / "log"))
        assert spark.read.schema("chat_id long, closed_at timestamp, closed_by string, facts string").parquet(str(tmp_path / "out")).count() == 3 * k
    got = sorted((r.chat_id, r.closed_by, r.facts) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "result", "2,3,no,yes"), (1, "topic", "1"), (2, "result", "free text")]
