"""Operators over several partitions, blocks and shards against brute force; clashing names and empty tables."""

import hashlib
import pathlib
import re
import uuid
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import embedding_dedup, language_id, shared, substring_dedup, toxicity
from quillspark.llm import queries as Q
from quillspark.llm.embedding_dedup import embedding_groups
from quillspark.llm.exact_dedup import exact_dedup
from quillspark.llm.lm_score import score_texts
from quillspark.llm.mixing import mix_sources
from quillspark.llm.near_dedup import near_dedup, near_groups
from quillspark.llm.packing import TOKENIZER, WordEncoder, pack
from quillspark.llm.substring_dedup import repeated_spans
from tests.conftest import SF
from tests.llm.test_operators import ODD, frame


def test_packing_query_against_tokenizer(spark):
    """Every id lies in one piece, digests are those of the ids, sequences have no gaps, and few are short."""
    whole, rows = Tokenizer.from_file(public_tokenizers.path(TOKENIZER)), Q.op6_packing(spark, SF).collect()
    pieces, at = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert pieces.keys() == {d.doc_id for d in docs}
    for d in docs:
        ids, start = [*whole.encode(d.text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[d.doc_id], key=lambda r: r.start):
            part = ids[r.start : r.start + r.length]
            assert r.start == start and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            start += r.length
        assert start == len(ids)
    for spots in at.values():
        spots.sort()
        assert [o for o, _ in spots] == list(np.cumsum([0] + [n for _, n in spots[:-1]])) and sum(n for _, n in spots) <= 2048
    assert sum(sum(n for _, n in s) < 2048 for s in at.values()) <= 1


def test_pieces_of_odd_texts():
    """Contractions, digits, marks, special tokens, letters beyond Latin, controls and white space as the tokenizer has them."""
    path = public_tokenizers.path(TOKENIZER)
    whole, words = Tokenizer.from_file(path), WordEncoder(path)
    quotes = "'" * 4
    texts = [
        "don't you're WE'LL I'M he'd o'clock 'sun --'s 's '' x'S 'Tis rock'n'roll", "<|endoftext|> a<|ENDOFTEXT|>b <|startoftext|>", "3.14 a1b2c3 ½ ² x²y",
        "a×b ÷ ¿qué? ¡sí! «x»  nbsp sep \x1c ctl\x1d", "日本語 émilé İstanbul ẞ ΑΣ ас", "", "  \n\t ",
        "x" * 3000, f"....!!!?? -- {quotes}s", "é É ÀÉ ſ ǅ ŉ", "a\x00b \x7f del", "\U0001f389party\U0001f389 '",
    ]
    for text, ids in zip(texts, words.encode([t.encode() for t in texts])):
        assert whole.encode(text, add_special_tokens=False).ids == ids.tolist()


def covered(data, runs=None):
    """What stays of each text (id, text) when repeated strings of 100 bytes go, by plain sets; ``runs``: removed runs of each."""
    seen, want = set(), {}
    for d, t in data:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                cover[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        want[d] = bytes(x for x, c in zip(b, cover) if not c)
        if runs is not None:
            runs[d] = len(re.findall(b"\1+", bytes(cover)))
    return want


def test_substrings_over_many_shards(spark):
    """Real texts over several partitions, shards of some kB and queues that are all on disk."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 2 = 0").select("doc_id", "text").repartition(4)
    want = covered(sorted((r.doc_id, r.text) for r in docs.collect()))
    got = repeated_spans(docs, shard_bytes=60_000, queue_bytes=0).collect()
    assert {r.doc_id: bytes(r.kept) for r in got} == want and any(len(want[r.doc_id]) < r.n_bytes for r in got)


def test_substrings_of_repeated_rows(spark):
    """Rows that share id and text count as one document; null ids come last."""
    part = "".join(np.random.default_rng(5).choice(list("abcde "), 150))
    data = [(1, "x" + part, "s"), (1, "x" + part, "s"), (None, part + "y", "s"), (2, part, "s")]
    got = sorted((r.doc_id or 9, bytes(r.kept).decode()) for r in repeated_spans(frame(spark, data)).collect())
    assert got == [(1, "x" + part), (1, "x" + part), (2, ""), (9, "y")]


def test_substrings_of_rows_alike_are_marked_once(spark, monkeypatch):
    """Hundreds of rows with one id and text bring the marks and spans of one row, not those of all to each of them."""
    most = {}

    def noted(df, name):
        out = shared.stored(df, name)
        if name in ("marks-owned", "spans"):
            most.setdefault(name, []).append(out.select(F.max(F.size(out.columns[-1]))).first()[0])
        return out

    monkeypatch.setattr(substring_dedup, "stored", noted)
    part = "".join(np.random.default_rng(6).choice(list("abcde "), 1500))
    for copies in (2, 300):
        data = [(0, part[:700], "s")] + [(1, part, "s")] * copies
        got = repeated_spans(frame(spark, data).repartition(4)).collect()
        assert sorted((r.doc_id, bytes(r.kept).decode()) for r in got) == [(0, part[:700])] + [(1, part[700:])] * copies
    assert len(set(most["marks-owned"])) == len(set(most["spans"])) == 1


def test_substring_query_against_sets(spark):
    """Counts, spans and digests of all documents."""
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    runs = {}
    want = covered(docs, runs)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in Q.op8_substring_dedup(spark, SF).collect()}
    size = {d: len((t or "").encode()) for d, t in docs}
    assert got == {d: (size[d], size[d] - len(k), runs[d], hashlib.sha256(k).hexdigest()) for d, k in want.items()}


def test_vectors_over_many_blocks(spark, monkeypatch):
    """Groups of some hundred near vectors meet in several blocks and batches of a list; none of their links is lost."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(4, 16))
    x = np.concatenate([c + 0.12 * rng.normal(size=(250, 16)) for c in centers] + [rng.normal(size=(100, 16))])
    df = spark.createDataFrame([(k, [float(y) for y in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    label, old = np.arange(len(x)), None
    while old is None or (label != old).any():
        old, label = label, np.array([min([label[k], *label[near[k]]]) for k in range(len(x))])
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_groups(df).collect()}
    assert got == {k: (int(near[k].sum()), int(label[k])) for k in range(len(x))} and near.sum() > 10_000


def test_near_copies_of_one_text(spark):
    """A large group of copies with more and less altered members, many apart from the centre: no link is lost."""
    rng = np.random.default_rng(12)
    data = []
    for k in range(220):
        words = [f"w{j}" for j in range(80)]
        for j in rng.choice(80, rng.integers(0, 7), replace=False):
            words[j] = f"other{rng.integers(0, 12)}"
        data.append((k, " ".join(words), "s"))
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for _, t, _ in data]
    label = list(range(len(data)))
    links = [(a, b) for a in range(len(data)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in data:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.doc_id: r.component_id for r in near_groups(frame(spark, data)).collect()} == dict(enumerate(label))


def test_language_by_hand(spark):
    """Held-out accuracy, and the same answers from the network's own sums over all windows of whole texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = Q.op3_language_id(spark, SF).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in judged if r.held_out and r.lang is not None]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held) > 20
    model = language_id.train_language_id(docs.select("doc_id", "text", "lang"), Q.fold(4) != 2)
    for r in judged[::9]:
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        raw = r.text.encode()
        scores = []
        for window in np.frombuffer(raw.ljust(-(-len(raw) // language_id.WINDOW) * language_id.WINDOW, b"\0"), np.uint8).reshape(-1, language_id.WINDOW):
            e, tops = model.embed[window], []
            for w, f, b in zip(language_id.WIDTHS, model.filters, model.biases):  # every filter at every place, then the greatest
                flat = f.reshape(-1, f.shape[-1])
                tops.append(np.max([e[i : i + w].ravel() @ flat + b for i in range(len(e) - w + 1)], 0))
            z = np.maximum(np.concatenate(tops), 0) @ model.out + model.out_bias
            scores.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
        mean = np.mean(scores, 0)
        assert model.languages[int(mean.argmax())] == r.lang_pred and abs(mean.max() - r.score) < 1e-3


def test_toxicity_on_held_out_rows(spark):
    """All documents are scored, held-out toxic ones above clean ones, and long texts by their worst window."""
    big = SF.replace("0.001", "0.01")
    scored = {r.doc_id: r for r in Q.op2_toxicity(spark, big).collect()}
    marks = spark.read.parquet(f"{big}/labels.parquet")
    labels = {r.doc_id: r.toxic for r in marks.collect()}
    docs = spark.read.parquet(f"{big}/documents.parquet")
    assert len(scored) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in scored.items())
    toxic, clean = ([scored[d].score for d, y in labels.items() if y == k and d in scored and scored[d].held_out] for k in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean]) >= 0.9
    assert np.mean([s >= 0.5 for s in toxic] + [s < 0.5 for s in clean]) >= 0.9
    model = toxicity.train_toxicity(docs.select("doc_id", "text"), marks, Q.fold(5) != 0)
    worst = max((d for d, y in labels.items() if y == 1 and d in scored), key=lambda d: scored[d].score)
    texts = {r.doc_id: r.text for r in docs.collect()}
    mild = " ".join((texts[min(scored, key=lambda d: scored[d].score)] or "").split() * 3)
    rows = spark.createDataFrame([(1, mild), (2, f"{mild} {texts[worst]} {mild}"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(rows, model).collect()}
    assert got[2] >= 0.5 > got[1] and got[3] == got[4] == 0


CLASHES = "_id _label _digest _sha _all gone_id kept _guess doc_row pass t a b key n m comp text_a id sub block part word bits".split()


def test_clashing_columns(spark):
    """Operators that return the rows of a table keep its columns, whatever they are called."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit("clash"))
    labels = spark.createDataFrame([(1, 0), (5, 1), (2, 0), (6, 1)], "doc_id long, toxic int").withColumn("_id", F.lit(3)).withColumn("text", F.lit("clash"))
    network = toxicity.train_toxicity(docs, labels, F.lit(True))
    languages = language_id.train_language_id(docs.withColumn("lang", F.lit("en")), F.lit(True))
    for out in (exact_dedup(docs), near_dedup(docs), toxicity.score_toxicity(docs, network), language_id.identify_language(docs, languages), mix_sources(docs), pack(docs)):
        rows = out.collect()
        assert rows and set(CLASHES) <= set(out.columns) and all(r[c] == "clash" for r in rows for c in CLASHES)


def test_empty_tables(spark):
    none = frame(spark).limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train_toxicity(none, labels, F.lit(True)) is None and toxicity.score_toxicity(none, None).count() == 0
    assert language_id.train_language_id(none.withColumn("lang", F.lit("en")), F.lit(True)) is None and language_id.identify_language(none, None).count() == 0
    assert pack(none).count() == 0 and pack(none.select("doc_id", "text")).count() == 0
    assert score_texts(none, F.lit(True)).count() == 0 and repeated_spans(none).count() == 0
    assert exact_dedup(none).count() == 0 and near_dedup(none).count() == 0


def test_vectors_meet_in_few_copies(spark, monkeypatch, tmp_path):
    """Nearly random vectors, which reach most lists, are not sent to each of them: all tasks together take a few times the input."""
    rng = np.random.default_rng(15)
    x = rng.normal(size=(6000, 64)).astype(np.float32)
    x[100:130] = x[99] + 0.05 * rng.normal(size=(30, 64)).astype(np.float32)
    search = embedding_dedup._search

    def counted(*given):
        run, folder = search(*given), str(tmp_path)

        def taken(key, table):
            (pathlib.Path(folder) / uuid.uuid4().hex).write_text(str(table.nbytes))
            return run(key, table)

        return taken

    monkeypatch.setattr(embedding_dedup, "_search", counted)
    df = spark.createDataFrame([(k, [float(y) for y in v]) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_groups(df).collect()}
    assert got == {k: (30, 99) if 99 <= k < 130 else (0, k) for k in range(6000)}
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) < 4 * 6000 * 64 * 8
