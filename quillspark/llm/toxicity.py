"""Toxicity scoring by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters the network as the sum of two hashed views, of the whole word and of its character trigrams. The network
reads overlapping windows of words in both directions; a text is as toxic as its worst window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh

#: Words of a window and from one window to the next; longer runs without white space count as several words.
WINDOW, STRIDE, WORD_CHARS = 48, 36, 48
WORD_BUCKETS, TRIGRAM_BUCKETS, FEATURES, HIDDEN, ATTENTION = 8192, 16384, 16, 8, 8
#: The network is fitted on a sample of labelled rows: about so many of each label, chosen by a hash of the id.
PER_LABEL = 1000
STEPS, BATCH, RATE = 480, 128, 0.006
#: In training, the windows that stand for a text in an epoch; texts to be judged are scored in all their windows.
WORST = 3
#: Words whose inputs a Python worker keeps.
CACHE = 200_000


def words_of(text: str | None) -> list[str]:
    words = (text or "").lower().split()
    if any(len(w) > WORD_CHARS for w in words):
        words = [w[i : i + WORD_CHARS] for w in words for i in range(0, len(w), WORD_CHARS)]
    return words


def hashed_words(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, buckets of all trigrams one after another, and where each word's trigrams begin."""
    raw = [b"\n" + w.encode("utf-8", "replace") + b"\n" for w in words]
    lengths = np.array([len(r) for r in raw])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    b = np.frombuffer(b"".join(raw) + b"\n\n", np.uint8).astype(np.uint64)
    tri = ((b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
    inside = np.ones(lengths.sum(), bool)
    ends = starts + lengths
    inside[ends - 1] = False
    inside[ends - 2] = lengths < 4  # a word of one byte has one trigram, as longer ones have one a byte
    place = np.arange(len(inside)) - np.repeat(starts, lengths)
    powers = np.uint64(0x100000001B3) ** np.arange(lengths.max(), dtype=np.uint64)
    whole = np.add.reduceat((b[: len(inside)] + np.uint64(1)) * powers[place], starts) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    counts = np.add.reduceat(inside.astype(np.int64), starts)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return (whole % np.uint64(WORD_BUCKETS)).astype(np.int64), (tri[: len(inside)][inside] % np.uint64(TRIGRAM_BUCKETS)).astype(np.int64), first


def cut_windows(n_words: int) -> list[tuple[int, int]]:
    """(begin, end) of overlapping windows that cover all words; none for an empty text."""
    if not n_words:
        return []
    begins = range(0, max(1, n_words - (WINDOW - STRIDE)), STRIDE)
    return [(b, min(b + WINDOW, n_words)) for b in begins]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class BiGru:
    """Two gated recurrent layers, one for each direction (first axis), and attention over their joint states."""

    def __init__(self, rng: np.random.Generator) -> None:
        normal = lambda scale, *shape: (rng.normal(0, 1, shape) * scale).astype(np.float32)
        h = HIDDEN
        self.word = normal(0.3, WORD_BUCKETS, FEATURES)
        self.tri = normal(0.5, TRIGRAM_BUCKETS, FEATURES)
        self.w = normal(FEATURES**-0.5, 2, FEATURES, 3 * h)
        self.b = np.zeros((2, 1, 3 * h), np.float32)
        self.u = normal(h**-0.5, 2, h, 3 * h)
        self.wa = normal((2 * h) ** -0.5, 2 * h, ATTENTION)
        self.va = normal(ATTENTION**-0.5, ATTENTION)
        self.out = normal((2 * h) ** -0.5, 2 * h)
        self.bias = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.word, self.tri, self.w, self.b, self.u, self.wa, self.va, self.out, self.bias]

    def features(self, hashed: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        words, trigrams, first = hashed
        counts = np.diff(np.append(first, len(trigrams)))
        return self.word[words] + np.add.reduceat(self.tri[trigrams], first) / np.sqrt(counts)[:, None].astype(np.float32)

    def inputs(self, hashed: tuple) -> np.ndarray:
        """What each word adds to the gates, 2 x words x 3 HIDDEN."""
        return self.features(hashed) @ self.w + self.b

    def forward(self, gates: np.ndarray, ids: np.ndarray, keep: bool = False) -> tuple:
        """Logits of windows; ids: windows x WINDOW rows of ``gates``, -1 after the end."""
        h, n = HIDDEN, len(ids)
        mask = (ids >= 0).astype(np.float32)
        state = np.zeros((2, n, h), np.float32)
        states, trace = np.empty((WINDOW, 2, n, h), np.float32), []
        for t in range(WINDOW):
            back = WINDOW - 1 - t
            x = np.stack([gates[0, ids[:, t]], gates[1, ids[:, back]]])
            m = np.stack([mask[:, t], mask[:, back]])[:, :, None]
            hu = state @ self.u
            zr = _sigmoid(x[:, :, : 2 * h] + hu[:, :, : 2 * h])
            z, r = zr[:, :, :h], zr[:, :, h:]
            c = np.tanh(x[:, :, 2 * h :] + r * hu[:, :, 2 * h :])
            new = state + m * (1 - z) * (c - state)
            if keep:
                trace.append((state, hu, z, r, c, m))
            state = new
            states[t, 0], states[back, 1] = new[0], new[1]
        joint = np.concatenate([states[:, 0], states[:, 1]], 2)  # WINDOW x n x 2 HIDDEN
        seen = np.tanh(joint @ self.wa)
        e = seen @ self.va + np.where(mask.T > 0, np.float32(0), np.float32(-1e9))
        e = np.exp(e - e.max(0))
        a = e / e.sum(0)
        pooled = np.einsum("tn,tnh->nh", a, joint)
        return pooled @ self.out + self.bias, (trace, joint, seen, a, pooled)

    def gradients(self, hashed: tuple, ids: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        h, n = HIDDEN, len(ids)
        x = self.features(hashed)
        gates = x @ self.w + self.b
        logits, (trace, joint, seen, a, pooled) = self.forward(gates, ids, True)
        d = ((_sigmoid(logits) - labels) * weights / n).astype(np.float32)
        d_out, d_bias = pooled.T @ d, np.array([d.sum()], np.float32)
        d_pooled = d[:, None] * self.out
        d_a = np.einsum("nh,tnh->tn", d_pooled, joint)
        d_e = a * (d_a - (a * d_a).sum(0))
        d_va = np.einsum("tn,tna->a", d_e, seen)
        d_seen = d_e[:, :, None] * self.va * (1 - seen * seen)
        d_wa = joint.reshape(-1, 2 * h).T @ d_seen.reshape(-1, ATTENTION)
        d_joint = a[:, :, None] * d_pooled + d_seen @ self.wa.T
        d_gates, d_u, d_state = np.zeros_like(gates), np.zeros_like(self.u), np.zeros((2, n, h), np.float32)
        for t in reversed(range(WINDOW)):
            back = WINDOW - 1 - t
            state, hu, z, r, c, m = trace[t]
            d_new = d_state + np.stack([d_joint[t, :, :h], d_joint[back, :, h:]])
            d_c = d_new * m * (1 - z) * (1 - c * c)
            d_z = d_new * m * (state - c) * z * (1 - z)
            d_r = d_c * hu[:, :, 2 * h :] * r * (1 - r)
            d_hu = np.concatenate([d_z, d_r, d_c * r], 2)
            d_u += state.transpose(0, 2, 1) @ d_hu
            d_state = d_new * (1 - m * (1 - z)) + d_hu @ self.u.transpose(0, 2, 1)
            d_x = np.concatenate([d_z, d_r, d_c], 2)
            for k, at in ((0, ids[:, t]), (1, ids[:, back])):
                np.add.at(d_gates[k], at, d_x[k])
        d_w = x.T @ d_gates
        d_feature = (d_gates @ self.w.transpose(0, 2, 1)).sum(0)
        words, trigrams, first = hashed
        counts = np.diff(np.append(first, len(trigrams)))
        d_word, d_tri = np.zeros_like(self.word), np.zeros_like(self.tri)
        np.add.at(d_word, words, d_feature)
        np.add.at(d_tri, trigrams, np.repeat(d_feature / np.sqrt(counts)[:, None].astype(np.float32), counts, 0))
        return [d_word, d_tri, d_w, d_gates.sum(1, keepdims=True), d_u, d_wa, d_va, d_out, d_bias]


def _batch(windows: list[list[str]]) -> tuple[tuple, np.ndarray]:
    known: dict[str, int] = {}
    ids = np.full((len(windows), WINDOW), -1)
    for k, window in enumerate(windows):
        ids[k, : len(window)] = [known.setdefault(w, len(known)) for w in window]
    return hashed_words(list(known)), ids


class Scorer:
    """Window scores of texts, with the inputs of frequent words kept."""

    def __init__(self, model: BiGru) -> None:
        self.model, self.known = model, {}
        self.gates = np.zeros((2, 1024, 3 * HIDDEN), np.float32)

    def _learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > CACHE:
            self.known.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        while len(self.known) + len(new) > self.gates.shape[1]:
            self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)], 1)
        first = len(self.known)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.gates[:, first + i : first + i + len(part)] = self.model.inputs(hashed_words(part))
        self.known.update((w, first + i) for i, w in enumerate(new))

    def windows(self, texts: list[str | None]) -> list[np.ndarray]:
        """Probabilities of all windows of each text."""
        split = [words_of(t) for t in texts]
        get = self.known.get
        ids = [list(map(get, words)) for words in split]
        if any(None in i for i in ids):
            # Clearing the kept words changes numbers given before, so all words of the batch are looked up again.
            self._learn([w for words in split for w in words])
            ids = [[self.known[w] for w in words] for words in split]
        cuts = [cut_windows(len(words)) for words in split]
        table = np.full((sum(map(len, cuts)), WINDOW), -1, np.int32)
        row = 0
        for i, cut in zip(ids, cuts):
            own = np.array(i, np.int32)
            for begin, end in cut:
                table[row, : end - begin] = own[begin:end]
                row += 1
        scores = np.concatenate([np.zeros(0, np.float32), *(_sigmoid(self.model.forward(self.gates, table[i : i + 1024])[0]) for i in range(0, len(table), 1024))])
        ends = np.cumsum([len(c) for c in cuts])
        return np.split(scores, ends[:-1]) if len(cuts) else []


def fit(texts: list[str], labels: list[int], seed: int = 11) -> BiGru:
    """Adam on windows of labelled texts.

    A toxic text need not be toxic everywhere, and a text counts by its worst window: after the first epoch the windows
    that score highest stand for a text, of a clean one with some others beside them. Every sixth text is left out; the
    bias is then set midway between those of either label.
    """
    rng = np.random.default_rng(seed)
    model = BiGru(rng)
    held = ([t for t in texts[::6]], np.array(labels[::6]))
    texts, labels = [t for k, t in enumerate(texts) if k % 6], [y for k, y in enumerate(labels) if k % 6]
    moments, step = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parameters()], 0
    split = [words_of(t) for t in texts]
    cuts = [cut_windows(len(s)) for s in split]
    epoch = 0
    while step < STEPS:
        chosen: list[tuple[list[str], int]] = []
        scorer = Scorer(model)
        for begin in range(0, len(texts), 256):
            scored = scorer.windows(texts[begin : begin + 256]) if epoch else [rng.random(len(c)) for c in cuts[begin : begin + 256]]
            for k, score in enumerate(scored, begin):
                top = list(np.argsort(-score)[:WORST])
                if epoch and labels[k]:
                    top = top[:1] + [i for i in top[1:] if score[i] >= 0.5]
                if not labels[k] and len(score):
                    top += list(rng.choice(len(score), min(len(score), WORST), replace=False))
                chosen += [(split[k][cuts[k][i][0] : cuts[k][i][1]], labels[k]) for i in dict.fromkeys(top)]
        order = rng.permutation(len(chosen))
        positive = max(1, sum(y for _, y in chosen))
        balance = np.clip((len(chosen) - positive) / positive, 0.3, 2)
        for i in range(0, len(order), BATCH):
            part = [chosen[k] for k in order[i : i + BATCH]]
            hashed, ids = _batch([w for w, _ in part])
            y = np.array([y for _, y in part], np.float32)
            step += 1
            rate = RATE * (1 if step < 0.75 * STEPS else 0.3)
            for p, g, (m, v) in zip(model.parameters(), model.gradients(hashed, ids, y, np.where(y > 0, balance, 1)), moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= np.float32(rate / (1 - 0.9**step)) * m / (np.sqrt(v / np.float32(1 - 0.999**step)) + np.float32(1e-8))
        epoch += 1
        if not chosen:
            break
    worst = np.array([w.max() if len(w) else 0.0 for w in Scorer(model).windows(held[0])])
    logits = np.log((worst + 1e-7) / (1 - worst + 1e-7))
    if len(set(held[1])) == 2:
        model.bias -= np.float32(_between(logits, held[1]))
    return model


def _between(logits: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the best mean of both labels' hit rates; midway, if a stretch is equally good."""
    order = np.argsort(logits, kind="stable")
    x, y = logits[order], labels[order]
    below = np.concatenate([[0], np.cumsum(y == 0)]) / max(1, (y == 0).sum())
    above = 1 - np.concatenate([[0], np.cumsum(y == 1)]) / max(1, (y == 1).sum())
    best = np.flatnonzero(below + above >= (below + above).max() - 1e-12)
    low, high = best[0], best[-1]
    return float((x[max(low - 1, 0)] + x[min(high, len(x) - 1)]) / 2)


def train_toxicity(docs: DataFrame, labels: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = PER_LABEL) -> BiGru | None:
    """Fit on labelled rows where ``trains`` holds; None unless both labels occur.

    About ``per_label`` rows of each label come to the driver, chosen by a hash of the id; rows with a null text, id or
    label are no examples. A text with several labels is an example of each.
    """
    known = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"))
    rows = docs.filter(trains & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    counts = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("_id")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("_label") == 1, min(1.0, per_label / counts[1])).otherwise(min(1.0, per_label / counts[0]))
    chosen = F.broadcast(known.filter(draw < share))  # about 2 x per_label pairs of id and label
    sample = rows.join(chosen, "_id").select("_id", "text", F.col("_label").cast("int").alias("label")).toPandas()
    sample = sample.sort_values(["_id", "label", "text"], kind="stable")
    if sample["label"].nunique() < 2:
        return None
    return fit(list(sample["text"]), [int(x) for x in sample["label"]])


def score_toxicity(docs: DataFrame, model: BiGru | None, text_col: str = "text") -> DataFrame:
    """Add ``score``, the highest probability over all overlapping windows of the whole text, from 0 to 1.

    Edge cases: null texts, texts without a word, and all texts if there is no model score 0; repeated rows score alike;
    an empty table gives an empty one; a column named ``score`` is replaced, others pass through.
    """
    own = [c for c in docs.columns if c.lower() != "score" or c == text_col]
    if model is None:
        return docs.select(*own, F.lit(0.0).alias("score"))

    @F.pandas_udf("double")
    def score_udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in parts:
            out: list[float] = []
            for i in range(0, len(texts), 256):
                out += [float(w.max()) if len(w) else 0.0 for w in scorer.windows(list(texts.iloc[i : i + 256]))]
            yield pd.Series(out, dtype="float64")

    return docs.select(*own, score_udf(F.col(text_col).cast("string")).alias("score"))
