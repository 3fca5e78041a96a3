"""Quality rules: counts against DuckDB and plain Python, probabilities against a dictionary of the same model."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quillspark.llm import quality_rules as Q
from quillspark.llm.queries import QUERIES

from ..conftest import SF

SCHEMA = "doc_id long, text string, lang string"


def plain_bits(texts):
    """Bits a character of each text under the counts of the other fold."""
    normal = [" ".join(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t in texts]
    folds = [zlib.crc32((t or "").encode()) & 1 for t in texts]
    grams = lambda t: [t[i : i + Q.ORDER] for i in range(len(t) - Q.ORDER + 1)]
    every = {g for t in normal for g in grams(t)}
    models = []
    for fold in (0, 1):
        counts = {Q.ORDER: Counter(g for t, f in zip(normal, folds) if f == fold for g in grams(t))}
        for k in range(Q.ORDER - 1, 0, -1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])
        d, context = {}, defaultdict(list)
        for k, c in counts.items():
            n = Counter(c.values())
            d[k] = [0.5, 1.0, 1.5]
            if all(n[i] for i in (1, 2, 3, 4)):
                y = n[1] / (n[1] + 2 * n[2])
                estimate = [i - (i + 1) * y * n[i + 1] / n[i] for i in (1, 2, 3)]
                if estimate[0] > 0 and estimate[1] > 0 and estimate[2] > 0:  # none can exceed its count
                    d[k] = estimate
            for g, v in c.items():
                context[g[:-1]].append(v)
        alphabet = len({ch for g in every for ch in g[-1:]})

        models.append((counts, d, context, alphabet))

    def p(g, counts, d, context, alphabet):
        if not g:
            return 1 / (alphabet + 1)
        low, seen, k = p(g[1:], counts, d, context, alphabet), context.get(g[:-1]), len(g)
        if not seen:
            return low
        c = counts[k][g]
        gamma = sum(d[k][min(v, 3) - 1] for v in seen)
        return (c - (d[k][min(c, 3) - 1] if c else 0) + gamma * low) / sum(seen)

    out = []
    for t, f in zip(normal, folds):
        g = grams(t)
        out.append(-sum(math.log2(p(x, *models[1 - f])) for x in g) / len(g) if g else None)
    return out


def plain_repeats(text):
    words = (text or "").encode().split()
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)})


@pytest.mark.parametrize("most", [Q.BROADCAST, 0])
def test_query_equals_plain_python(spark, duck, monkeypatch, most):
    monkeypatch.setattr(Q, "BROADCAST", most)
    got = {r["doc_id"]: r for r in QUERIES["op11_quality_rules"](spark, SF).collect()}
    docs = duck.execute("select doc_id, text from documents").fetchall()
    assert len(got) == len(docs)
    for (i, text), bits in zip(docs, plain_bits([t for _, t in docs])):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
        r = got[i]
        expected = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), plain_repeats(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (len(words) < 20 or 100 * expected[-1] > 30 * len(words))
        assert bits is None or abs(math.log2(r["perplexity"]) - bits) < 1e-4
        assert r["kept"] == (not r["base_failed"] and (bits is None or r["lower"] <= r["perplexity"] <= r["upper"]))


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(Q, "GROUP", 1 << 12)
    monkeypatch.setattr(Q, "FLUSH", 1 << 6)
    monkeypatch.setattr(Q, "ALPHABET", 40)  # groups are halved
    long_text = " ".join(f"word{i * 7919 % 1000} ünïcode{i % 13} 漢字{i % 7} 🙂" for i in range(60_000))  # above one piece
    rows = [(1, None, "en"), (2, "", None), (3, " \n\t ", "en"), (4, long_text, None), (5, long_text, None), (None, "ab", "xx"), (6, "a b c d e f g h i " * 4, "en"), (7, "x\n\nx\n x\nx", "en")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], f"{SCHEMA}, kept int, BITS int, h int")
    got = {r["doc_id"]: r for r in Q.judge_quality(docs).collect()}
    assert len(got) == len(rows)
    for i in (1, 2, 3):
        assert got[i]["n_words"] == 0 and got[i]["base_failed"] and not got[i]["kept"] and got[i]["perplexity"] is None
    assert got[7]["n_dup_lines"] == 2 and got[6]["n_repeat_words"] == 36 and got[6]["base_failed"]
    assert got[4]["perplexity"] == got[5]["perplexity"] and got[4]["n_repeat_words"] == plain_repeats(long_text)
    for (i, text, _), bits in zip(rows, plain_bits([t for _, t, _ in rows])):
        assert bits is None or abs(math.log2(got[i]["perplexity"]) - bits) < 1e-4
    assert Q.judge_quality(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clean_texts_stay_and_odd_ones_go(spark):
    import random

    draw = random.Random(3)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "tempor", "magna", "aliqua", "enim", "minim"]
    texts = [" ".join(draw.choices(words, k=80)) for _ in range(300)]
    odd = ["".join(chr(draw.randrange(97, 123)) + " " * (draw.random() < 0.2) for _ in range(500)) for _ in range(5)]
    docs = spark.createDataFrame([(i, t, "la") for i, t in enumerate(texts + odd)], SCHEMA)
    got = {r["doc_id"]: r["kept"] for r in Q.judge_quality(docs).collect()}
    assert sum(got[i] for i in range(300)) >= 297
    assert not any(got[i] for i in range(300, 305))
