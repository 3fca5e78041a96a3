"""Language identification by a byte convolutional network, trained in numpy.

Filters of several widths run over the bytes of fixed-length windows, their largest answers over a window go into a
softmax over the languages, and a text gets the mean of its windows' probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
#: The network is fitted on a sample of labelled rows: about so many of each language, chosen by a hash of the id; fewer of each
#: where there are so many languages that they would pass SAMPLE together.
PER_LANGUAGE, SAMPLE = 500, 100_000
EPOCHS, BATCH, RATE = 6, 128, 0.004
#: In training, windows of one text in an epoch, drawn from all its places, and of all texts together. Texts to be judged
#: are read whole.
TEXT_WINDOWS, EPOCH_WINDOWS = 24, 12_000
UNKNOWN = "und"


@dataclass
class ByteCnn:
    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def fresh(languages: list[str], rng: np.random.Generator) -> ByteCnn:
        normal = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        filters = [normal(w, EMBED, FILTERS) / np.sqrt(w * EMBED, dtype=np.float32) for w in WIDTHS]
        n = len(WIDTHS) * FILTERS
        return ByteCnn(languages, normal(256, EMBED) * np.float32(0.5), filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], normal(n, len(languages)) / np.sqrt(n, dtype=np.float32), np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.biases, self.out, self.out_bias]

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy over windows (n x WINDOW bytes)."""
        n, x = len(windows), self.embed[windows]
        pooled, places = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.biases):
            answers = sum(x[:, j : WINDOW - w + 1 + j] @ f[j] for j in range(w)) + b
            place = answers.argmax(1)
            places.append(place)
            pooled.append(np.take_along_axis(answers, place[:, None], 1)[:, 0])
        top = np.concatenate(pooled, 1)
        hidden = np.maximum(top, 0)
        p = _softmax(hidden @ self.out + self.out_bias)
        p[np.arange(n), labels] -= 1
        p /= n
        d_top = (p @ self.out.T) * (top > 0)
        d_embed, d_filters, d_biases = np.zeros_like(self.embed), [], []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            d, place = d_top[:, k * FILTERS : (k + 1) * FILTERS], places[k]
            d_f = np.zeros_like(f)
            for j in range(w):
                at = np.take_along_axis(windows, place + j, 1)  # the byte under each filter's best place
                d_f[j] = np.einsum("nfe,nf->ef", self.embed[at], d)
                np.add.at(d_embed, at, d[:, :, None] * f[j].T[None])
            d_filters.append(d_f)
            d_biases.append(d.sum(0))
        return [d_embed, *d_filters, *d_biases, hidden.T @ p, p.sum(0)]

    def tables(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """For each width the answers of byte pairs: a filter is one or two look-ups a place."""
        def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.ascontiguousarray((a[:, None] + b[None]).reshape(65536, FILTERS))

        made = []
        for w, f, b in zip(WIDTHS, self.filters, self.biases):
            t = [self.embed @ f[j] for j in range(w)]
            t[0] = t[0] + b
            made.append((pair(t[0], t[1]), None if w == 2 else pair(t[2], t[3]) if w == 4 else t[2].astype(np.float32)))
        return made

    def probabilities(self, windows: np.ndarray, tables: list) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for i in range(0, len(windows), 256):
            by_place = np.ascontiguousarray(windows[i : i + 256].T)
            pairs = by_place[:-1].astype(np.uint16) * np.uint16(256) + by_place[1:]
            pooled = []
            for w, (first, rest) in zip(WIDTHS, tables):
                answers = first[pairs[: WINDOW - w + 1]]
                if rest is not None:
                    answers += rest[pairs[2:] if w == 4 else by_place[2:]]
                pooled.append(answers.max(0))
            out[i : i + 256] = _softmax(np.maximum(np.concatenate(pooled, 1), 0) @ self.out + self.out_bias)
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def cut_windows(text: bytes) -> np.ndarray:
    """The whole text in windows of fixed length, the last one padded with zero bytes."""
    n = max(1, -(-len(text) // WINDOW))
    return np.frombuffer(text.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def fit(texts: list[bytes], langs: list[str], seed: int = 7) -> ByteCnn:
    """Adam over windows of the labelled texts; of each text up to TEXT_WINDOWS an epoch, from all its places."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    model = ByteCnn.fresh(names, rng)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parameters()]
    cut, step = [cut_windows(t) for t in texts], 0
    for _ in range(EPOCHS):
        parts = [(c if len(c) <= TEXT_WINDOWS else c[rng.choice(len(c), TEXT_WINDOWS, replace=False)], names.index(lang)) for c, lang in zip(cut, langs)]
        windows = np.concatenate([c for c, _ in parts])
        labels = np.concatenate([np.full(len(c), k) for c, k in parts])
        order = rng.permutation(len(windows))[:EPOCH_WINDOWS]
        for i in range(0, len(order), BATCH):
            at, step = order[i : i + BATCH], step + 1
            for p, g, (m, v) in zip(model.parameters(), model.gradients(windows[at], labels[at]), moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def train_language_id(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> ByteCnn | None:
    """Fit on rows where ``trains`` holds and text and language are not null; None if there are none.

    About ``per_language`` rows of each language come to the driver, chosen by a hash of the id; all rows of a language that has
    no more.
    """
    rows = docs.filter(trains & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = rows.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).select(F.col(lang_col).alias("lang"), "n")
    languages = counts.count()
    if not languages:
        return None
    each = max(1.0, min(per_language, SAMPLE / languages))
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.col(lang_col).alias("lang"), draw.alias("draw"))
    sample = drawn.join(F.broadcast(counts), "lang").filter(F.col("draw") < F.lit(each) / F.col("n")).select("id", "text", "lang").toPandas()
    if sample.empty:
        return None
    sample = sample.sort_values(["id", "lang"], kind="stable")
    return fit([bytes(t) for t in sample["text"]], list(sample["lang"]))


def identify_language(docs: DataFrame, model: ByteCnn | None, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` (a language of the model) and ``score`` (its mean probability over all windows).

    Edge cases: null text, text without a letter, and any text if there is no model get ``und`` and score 0; texts of
    any length are read whole; repeated rows are judged each, alike; an empty table gives an empty one; columns named
    like the results are replaced, others pass through.
    """
    own = [c for c in docs.columns if c.lower() not in ("lang_pred", "score") or c == text_col]
    (guess,) = fresh(docs, "_guess")
    nothing = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if model is None:
        return docs.select(*own, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    @F.pandas_udf("lang_pred string, score double")
    def guess_udf(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = model.tables()
        for texts in parts:
            langs, scores = [], []
            for i in range(0, len(texts), 512):
                cut = [cut_windows(t or b"") for t in texts.iloc[i : i + 512]]
                p = model.probabilities(np.concatenate(cut), tables).astype(np.float64)
                lengths = [len(c) for c in cut]
                mean = np.add.reduceat(p, np.cumsum([0, *lengths[:-1]]), 0) / np.array(lengths)[:, None]
                best = mean.argmax(1)
                langs += [model.languages[k] for k in best]
                scores.append(np.clip(mean[np.arange(len(cut)), best], 0, 1))
            yield pd.DataFrame({"lang_pred": langs, "score": np.concatenate(scores) if scores else []})

    text = F.col(text_col)
    judged = docs.withColumn(guess, guess_udf(text.cast("binary")))
    found = F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), F.col(guess)).otherwise(nothing)
    return judged.withColumn(guess, found).select(*own, F.col(f"{guess}.lang_pred").alias("lang_pred"), F.col(f"{guess}.score").alias("score"))
