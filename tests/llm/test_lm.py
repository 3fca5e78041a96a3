"""Language-model scores against plain Python: counts, word predictions, and whole scores bit by bit."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import lm_score as lm
from quillspark.llm import queries as Q
from quillspark.llm.near_dedup import word_hashes
from tests.conftest import SF

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall((text or "").encode().lower())


def test_counts_and_base(spark):
    got = {r.doc_id: r for r in Q.op7_lm_score(spark, SF).collect()}
    docs = {r.doc_id: [*words_of(r.text), None] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    known = Counter(w for d, ws in docs.items() if zlib.crc32(str(d).encode()) % 5 != 1 for w in ws)
    total, distinct = sum(known.values()), len(known)
    assert got.keys() == docs.keys()
    for d, ws in docs.items():
        base = sum(math.log10((known[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        assert (got[d].n_tokens, got[d].train_tokens, got[d].n_known) == (len(ws), total, sum(w in known for w in ws))
        assert got[d].base_score == pytest.approx(base, rel=1e-9) and got[d].score < 0


def followers_by_hand(tokens):
    """tokens: (context, word, trains). For each the cell and hit, by dictionaries."""
    seen = {}
    for c, w, t in tokens:
        seen.setdefault(c, Counter()).update([w] if t else [])
    met = Counter(c for c, _, _ in tokens)
    out = []
    for c, w, t in tokens:
        n = seen[c]
        if not n or met[c] == 1:
            out.append(0)
            continue
        first = min(n, key=lambda k: (-n[k], k))
        second = max([v for k, v in n.items() if k != first], default=0)
        times, hit = n[first], w == first
        if hit and t:
            times -= 1
            if times < second:
                times, hit = second, False
        others = sum(n.values()) - int(t) - times
        cell = 1 + np.searchsorted(lm.FOLLOWED, times, "right") * (len(lm.OTHERS) + 1) + np.searchsorted(lm.OTHERS, others, "right")
        out.append(int(2 * cell + hit) if times else 0)
    return out


def test_followers():
    rng = np.random.default_rng(1)
    for n in (1, 2, 40, 400):
        tokens = [(int(c), int(w), bool(t)) for c, w, t in zip(rng.integers(0, n // 8 + 1, n), rng.integers(0, 4, n), rng.random(n) < 0.8)]
        got = lm.followers(np.array([t[0] for t in tokens], np.uint64), np.array([t[1] for t in tokens], np.uint64), np.array([t[2] for t in tokens]))
        assert got.tolist() == followers_by_hand(tokens)


def letter_bits(mixer, counts):
    """What spelling each word takes, with dictionaries in place of tables."""
    coder, seen = mixer.coder, {}

    def path(word):
        s = [lm.PAD] * lm.PADS + list(word) + [lm.END]
        for i in range(lm.PADS, len(s)):
            for j in range(coder.length[s[i]]):
                node = int(coder.nodes[s[i], j])
                last = [(k, *s[i - k : i], node) for k in (1, 2, 3)]
                begun = ("all", *s[:i], node) if i - lm.PADS >= lm.TOGETHER else last[-1]
                yield [*last, begun], node, int(coder.bits[s[i], j])

    for word, n in counts.items():
        for keys, _, bit in path(word):
            for key in dict.fromkeys(keys):
                seen.setdefault(key, [0, 0])[bit] += n
    out = {}
    for word in counts:
        cost = 0.0
        for keys, node, bit in path(word):
            pairs = [seen[k] for k in keys]
            x = [min(max(math.log((o + 0.4) / (z + 0.4)), -lm.LIMIT), lm.LIMIT) for z, o in pairs]
            sure = [int(np.searchsorted((1, 4, 32), z + o, "right")) for z, o in pairs]
            gate = sure[2] * 4 + sure[3]
            z = min(max(sum(w * v for w, v in zip(mixer.weights[:-1, gate], x)) + mixer.weights[-1, gate], -lm.LIMIT), lm.LIMIT)
            level = int(np.rint((z + lm.LIMIT) * (lm.LEVELS - 1) / (2 * lm.LIMIT)))
            p = 1 / (1 + math.exp(-(z + mixer.refined[node, level]) / 2))
            cost -= math.log2(p if bit else 1 - p)
        out[word] = cost
    return out


def test_scores_bit_by_bit(spark, monkeypatch):
    """Whole scores over several blocks and hash ranges equal those of dictionaries with the weights that were learned."""
    monkeypatch.setattr(lm, "RANGE_TOKENS", 200)
    monkeypatch.setattr(lm, "RANGE_WORDS", 50)
    rng = np.random.default_rng(3)
    names = ["".join(rng.choice(list("abcdefgh"), rng.integers(1, 9))) for _ in range(60)]
    phrase = " ".join(rng.choice(names, 12))
    texts = [" ".join(rng.choice(names, rng.integers(0, 30))) + (f" {phrase}" if k % 3 == 0 else "") for k in range(40)] + [None, "", "Zz\x00 zz\x00", phrase, phrase]
    data = [(min(k, 43), t, k % 5 != 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string, trains boolean").repartition(3)
    got = sorted((r.doc_id, r.score) for r in lm.score_texts(docs, F.col("trains")).collect())
    split = [words_of(t) for t in texts]
    counts = Counter({w: 0 for ws in split for w in ws})
    counts.update(w for ws, (_, _, t) in zip(split, data) if t for w in ws)
    keys = {w: int(word_hashes([w])[0].view(np.int64)[0]) for w in counts}
    mixer, spelled = lm.train_letters(spark.createDataFrame([(keys[w], w, n) for w, n in counts.items()], "key long, word binary, n long"))
    cost = letter_bits(mixer, counts)
    assert {r.key: r.bits for r in spelled.collect()} == pytest.approx({keys[w]: c for w, c in cost.items()}, rel=1e-3)
    short = {w: (keys[w] & (1 << 64) - 1) >> 40 for w in keys}
    tokens = [((ws[i - 2] if i > 1 else 2, ws[i - 1] if i else 1), short[w], d[2]) for ws, d in zip(split, data) for i, w in enumerate(ws)]
    found = followers_by_hand(tokens)
    cells, place = [], 0
    for ws in split:
        run = 0
        for _ in ws:
            f = found[place]
            cells.append(((f >> 1) * (len(lm.RUNS) + 1) + int(np.searchsorted(lm.RUNS, run, "right")), f & 1, f > 0))
            run = run + 1 if f & 1 else 0
            place += 1
    trains = [d[2] for ws, d in zip(split, data) for _ in ws]
    seen = Counter((c, h) for (c, h, told), t in zip(cells, trains) if told and t)
    ends = sum(d[2] for d in data)
    total = sum(counts.values()) + ends
    end, place, want = (ends + 0.5) / (total + 1), 0, []
    for ws, d in zip(split, data):
        bits = -math.log2(end) - len(ws) * math.log2(1 - end)
        for w in ws:
            c, h, told = cells[place]
            place += 1
            if told:
                bits -= math.log2((seen[c, h] + 0.4) / (seen[c, 0] + seen[c, 1] + 0.8))
            if not (told and h):
                bits += cost[w]
        want.append((d[0], -bits * math.log10(2)))
    assert any(h for _, h, _ in cells) and [d for d, _ in got] == [d for d, _ in sorted(want)]
    assert [s for _, s in got] == pytest.approx([s for _, s in sorted(want)], rel=1e-3)


def test_null_empty_long_and_repeated_rows(spark):
    """Each row is scored; null and empty texts have their end only; a text longer than a piece counts all its words."""
    long = " ".join(f"word{k % 999}" for k in range(200_000))
    data = [(1, "one two"), (1, "one two"), (None, "one two"), (2, None), (3, ""), (4, " \t\n"), (5, long)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("block", F.lit("clash"))
    got = lm.score_texts(docs, F.coalesce(F.col("doc_id") != 3, F.lit(False))).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in got) == [(0, 3, 3), (1, 3, 3), (1, 3, 3), (2, 1, 1), (3, 1, 1), (4, 1, 1), (5, 200_001, 200_001)]
    assert len({r.score for r in got if r.n_tokens == 1}) == 1 and all(np.isfinite(r.score) and r.score < 0 for r in got)
