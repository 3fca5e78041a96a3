"""Keyword scores of texts taken together, and what words that overlap themselves count."""

import numpy as np

from quillspark.operators import retrieval


def counted(words, text):
    return {w: (text.count(w), text.index(w)) for w in words if w in text}


def test_occurrences_of_texts_together():
    words = ["aa", "aba", "ana", "an", "nan", "b"]
    texts = ["aaaaa abababa banananan", "", "xyz", "b", "anana ana aaa"]
    row, k, n, first = retrieval.Words(words).occurrences(texts)
    got = [{words[w]: (c, f) for r, w, c, f in zip(row, k, n, first) if r == i} for i in range(len(texts))]
    assert got == [counted(words, t) for t in texts]
    assert all(len(x) == 0 for x in retrieval.Words([]).occurrences(texts))


def test_texts_score_together_as_alone():
    queries = [(1, ["aa", "ana"], ["_2"], {"en"}), (2, ["b", "ana"], [""], set()), (3, ["zz"], [], {"fr"})]
    texts = [("doc_2", "en", "aaaa ana", "ANA"), ("doc_3", None, None, None), ("doc_4", "fr", "zz b" * 200, "b"), ("doc_5", "de", "none", "zz")]
    scorer = retrieval.Scorer(queries)
    row, *found = scorer.scores(texts)
    for i, text in enumerate(texts):
        alone, mine = scorer.score(*text), [x[row == i] for x in found]
        assert (alone is None and not len(mine[0])) or all(np.array_equal(a, b) for a, b in zip(alone, mine))
    assert scorer.score(*texts[0])[0].tolist() == [0, 1] and scorer.score(*texts[1]) is None


def test_ties_are_cut_where_they_are_read():
    best = retrieval._Best(1, 2)
    kept = 0
    for i in range(1000):
        best.add([f"u{i:04d}"], np.zeros(1, int), np.zeros(1, int), np.array([0.58]), np.array([False]), np.array([True]))
        kept = max(kept, len(best.held[0]))
    assert kept < 24 and len(best.held[0]) == 2  # later uids of the same worth don't come in again
    assert [uid for *_, uid in sorted(best.held[0])[:2]] == ["u0000", "u0001"]
