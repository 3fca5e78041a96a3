"""The training-data operators against brute force, with nulls, empty, long and repeated rows and clashing columns."""

import hashlib
import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import queries as Q
from quillspark.llm.embedding_dedup import embedding_groups
from quillspark.llm.exact_dedup import exact_dedup, exact_groups
from quillspark.llm.induced_sort import InducedSorter
from quillspark.llm.mixing import mix_sources
from quillspark.llm.near_dedup import near_dedup, near_groups
from quillspark.llm.oracle import ORACLE
from quillspark.llm.packing import TOKENIZER, WordEncoder, pack
from quillspark.llm.substring_dedup import repeated_spans
from quillspark.llm.url_filter import url_filter
from tests.conftest import SF
from tests.test_queries import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"word{i}" for i in range(60))
ODD = [(1, BASE, "a"), (2, BASE.upper(), "a"), (3, None, None), (4, "", "a"), (5, BASE + " more", "b"), (6, "x" * 50_000, "b"), (7, "one two", "b"), (7, "one two", "b"), (None, "other words stand here now", "c"), (9, " \t\n", "c"), (10, "ONE two", None)]


def frame(spark, data=ODD):
    return spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("score", F.lit("clash"))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    answer = duck.execute(ORACLE[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in answer.description], answer.fetchall())


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.ORG/x"), (2, None), (3, "no scheme"), (4, "https://m.example.org/en/17?q"), (5, "http://org"), (6, "http://x.com/FR/")], "page_id long, url string").withColumn("rule", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(pages, Q.URL_RULES).collect()}
    assert got == {1: ("a.org", "/x", "org/", "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("m.example.org", "/en/17", "example.org/en/1", "block"), 5: ("org", "", None, "allow"), 6: ("x.com", "/FR/", None, "allow")}
    assert url_filter(pages.limit(0), Q.URL_RULES).count() == 0


@pytest.mark.parametrize("table_bytes", [64 << 20, 300])
def test_exact(spark, table_bytes):
    got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_groups(frame(spark), table_bytes=table_bytes).collect())
    assert got == sorted([(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True), (7, 10, 3, False), (7, 10, 3, False), (0, None, 1, True), (9, 9, 1, True), (10, 10, 3, True)])
    kept = exact_dedup(frame(spark))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 4, 5, 6, 9, 10]
    assert exact_groups(frame(spark).limit(0)).count() == 0


def test_near(spark):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_groups(frame(spark)).collect())
    assert got == sorted([(1, 56, 1, True), (2, 56, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 57, 1, False), (6, 1, 6, True), (7, 1, 7, True), (7, 1, 7, True), (0, 1, None, True), (9, 0, 9, True), (10, 1, 7, False)])
    assert near_groups(frame(spark).limit(0)).count() == 0
    assert 2 not in {r.doc_id for r in near_dedup(frame(spark)).collect()}


def test_near_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sets = {}
    for d, t in docs:
        w = WORD.findall(t.translate({c: c + 32 for c in range(65, 91)}))
        sets[d] = set(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op5_near_dedup(spark, SF).collect()}
    assert got == {d: (len(s), find(d)) for d, s in sets.items()}


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (60, 8))
    x[30:50] = x[0] + 0.12 * rng.normal(0, 1, (20, 8))
    x[50:55] = x[1]
    data = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)] + [(60, None), (61, [0.0] * 8), (62, [float("nan")] * 8), (63, [1.0])]
    u = np.float32(x).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = u @ u.T >= 0.95
    label = np.arange(60)
    for _ in range(60):
        label = np.array([label[link[i]].min() for i in range(60)])
    want = {i: (int(link[i].sum()) - 1, int(label[i])) for i in range(60)} | {i: (0, i) for i in range(60, 64)}
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in embedding_groups(df).collect()} == want
    assert embedding_groups(df.limit(0)).count() == 0


def test_induced_sort():
    rng = np.random.default_rng(2)
    for memory in (0, 10_000):
        for _ in range(40):
            t = np.tile(rng.integers(0, 3, rng.integers(1, 12)), 4).astype(np.uint8)
            with tempfile.TemporaryDirectory() as folder:
                order = [int(p) for part, _ in InducedSorter(t, 100, folder, memory).order() for p in part]
            assert order == sorted(range(len(t)), key=lambda i: t.tobytes()[i:], reverse=True)


def test_substrings(spark):
    rng = np.random.default_rng(3)
    parts = ["".join(rng.choice(list("abcdeé "), 130)) for _ in range(6)]
    data = [(k, "".join(parts[j] for j in rng.integers(0, 6, 3)), "s") for k in range(12)] + [(20, None, "s"), (21, "", "s"), (22, "ab" * 200, "s"), (23, "short", "s")]
    seen, want = set(), {}
    for d, t, _ in data:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                cover[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        want[d] = bytes(x for x, c in zip(b, cover) if not c)
    assert {r.doc_id: bytes(r.kept) for r in repeated_spans(frame(spark, data)).collect()} == want


def test_substrings_of_long_text(spark):
    """Repeats beyond 16 MiB of one text, and behind smaller texts of its slice, are found where they are."""
    rng = np.random.default_rng(8)
    letters = lambda n: rng.integers(97, 123, n, np.uint8).tobytes().decode()
    passage, body = letters(300), letters((1 << 24) + 5000)
    data = [(1, passage, "s"), (2, body + passage, "s")]
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in repeated_spans(frame(spark, data).coalesce(1)).collect()}
    assert got == {1: [], 2: [(len(body), len(body) + 300)]}


def test_packing(spark):
    out = pack(frame(spark).select("doc_id", "text", "source"), window=64, open_windows=3).collect()
    whole = WordEncoder(__import__("public_tokenizers").path(TOKENIZER))
    pieces, at = {}, {}
    for r in out:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, list(r.ids)))
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in at.values():
        spots.sort()
        assert [o for o, _ in spots] == list(np.cumsum([0] + [n for _, n in spots[:-1]])) and sum(n for _, n in spots) <= 64
    assert sum(sum(n for _, n in s) < 64 for s in at.values()) <= 1
    for row in set(ODD):
        ids, times = [*whole.whole.encode(row[1] or "", add_special_tokens=False).ids, 1], ODD.count(row)
        cover = np.zeros(len(ids), int)
        for start, part in pieces[(row[0], len(ids))]:
            assert ids[start : start + len(part)] == part
            cover[start : start + len(part)] += 1
        assert (cover == times).all()


def test_mixing(spark):
    got = mix_sources(frame(spark)).collect()
    assert len(got) == len(ODD) and all(0 <= r.copies <= 3 for r in got)
    assert sum(r.copies * r["size"] for r in got) <= sum(r["size"] for r in got)
    assert mix_sources(frame(spark).limit(0)).count() == 0


def test_vectors_of_two_lengths(spark):
    """Vectors link within their own length, also in the smaller part of a table."""
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(5, 8)), rng.normal(size=(2, 12))
    vectors = [*a, a[0], b[0], b[0] * 2 + 0.001, b[1], b[0], [0.0] * 12, []]
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_groups(df).collect()}
    unit = [np.array(v) / np.linalg.norm(v) if np.any(v) else None for v in vectors]
    for k, u in enumerate(unit):
        near = [j for j, w in enumerate(unit) if j != k and u is not None and w is not None and len(u) == len(w) and u @ w >= 0.95]
        assert got[k] == (len(near), min([k, *near]), not near or k < min(near))
    assert got[9] == (2, 6, False)


def test_many_languages(spark):
    """Rare languages are learned as well, however many there are."""
    from quillspark.llm.language_id import train_language_id

    data = [(3 * k + j, f"word{k} " * 5, f"l{k:03}") for k in range(230) for j in range(3 if k < 200 else 1)]
    model = train_language_id(spark.createDataFrame(data, "doc_id long, text string, lang string"), F.lit(True))
    assert model.languages == [f"l{k:03}" for k in range(230)]


def test_digest_of_kept_text(spark):
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert hashlib.sha256(bytes(repeated_spans(df).first().kept)).hexdigest() == hashlib.sha256(b"abc").hexdigest()
