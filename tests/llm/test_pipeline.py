"""The pipeline, stage by stage against plain Python on a small table, and as a whole."""

import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm.oracle import ORACLE
from quillspark.llm.packing import TOKENIZER
from quillspark.llm.toxicity import Scorer, train_toxicity
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents of the smallest table, some again as exact and altered copies, with nulls and an empty text."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()][:120]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    rows += [(1000 + r[0], r[1].upper(), *r[2:]) for r in rows[:15]] + [(2000 + r[0], r[1] + " tail", *r[2:]) for r in rows[20:40]]
    rows += [(3000, None, None, None, None), (3001, "", "en", "src1", 0), (3001, "", "en", "src1", 0)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, small):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, rows = docs.columns, docs.collect()

    # Toxicity: all windows of all texts by the network itself.
    model = train_toxicity(docs.select("doc_id", "text"), spark.read.parquet(f"{small}/labels.parquet"), F.lit(True))
    worst = [w.max() if len(w) else 0.0 for w in Scorer(model).windows([r.text for r in rows])]
    mild = sorted((tuple(r) for r, s in zip(rows, worst) if s < 0.5), key=repr)
    out = stages["toxicity"](spark, docs, small)
    assert out.columns == columns and sorted(map(tuple, out.collect()), key=repr) == mild and len(mild) < len(rows)

    # Exact copies: the largest doc_id of each text, one row of rows that are alike.
    docs = spark.createDataFrame(mild, docs.schema)
    best = {}
    for r in mild:
        key = (r[1] or "").translate(LOWER)
        if key not in best or r[0] > best[key][0]:
            best[key] = r
    out = stages["exact_dedup"](spark, docs, small)
    assert out.columns == columns and sorted(map(tuple, out.collect()), key=repr) == sorted(best.values(), key=repr)

    # Near copies: the smallest doc_id of each group of linked texts.
    kept, sets = sorted(best.values()), []
    for r in kept:
        w = WORD.findall((r[1] or "").translate(LOWER))
        sets.append(set(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(kept)))
    links = [(a, b) for a in range(len(kept)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in kept:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    docs = spark.createDataFrame(kept, docs.schema)
    kept = [r for k, r in enumerate(kept) if label[k] == k]
    out = stages["near_dedup"](spark, docs, small)
    assert out.columns == columns and sorted(map(tuple, out.collect())) == kept and links

    # Mixing: as often as the SQL of the mixing query says.
    docs = spark.createDataFrame(kept, docs.schema)
    duck = duckdb.connect()
    duck.register("documents", docs.toPandas())
    taken = {r[0]: r[1] // max(r[2], 1) for r in duck.execute(f"SELECT doc_id, taken, size FROM ({ORACLE['op9_mixing']})").fetchall()}
    mixed = [tuple(r) for r in stages["mixing"](spark, docs, small).collect()]
    times = {r: mixed.count(r) for r in kept}
    assert all(times[r] == taken[r[0]] for r in kept if WORD.search(r[1] or "")) and set(mixed) <= set(kept)

    # Packing: each document's ids once for each time it was taken, in sequences without gaps.
    out = stages["packing"](spark, spark.createDataFrame(mixed, docs.schema), small).collect()
    whole, found, at = Tokenizer.from_file(public_tokenizers.path(TOKENIZER)), {}, {}
    for r in out:
        found.setdefault(r.doc_id, []).append(r)
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for m in set(mixed):
        ids = [*whole.encode(m[1] or "", add_special_tokens=False).ids, 1]
        cover = np.zeros(len(ids), int)
        for r in found[m[0]]:
            assert ids[r.start : r.start + r.length] == list(r.ids)
            cover[r.start : r.start + r.length] += 1
        assert (cover == times[m]).all()
    for spots in at.values():
        spots.sort()
        assert [o for o, _ in spots] == list(np.cumsum([0] + [n for _, n in spots[:-1]])) and sum(n for _, n in spots) <= 2048


def test_run(spark, small):
    """The whole is its stages, each on all that its predecessor kept."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    a, b = docs.collect(), corpus_pipeline.run(spark, small).collect()
    assert sum(r.length for r in a) == sum(r.length for r in b) and {(r.doc_id, r.doc_tokens) for r in a} == {(r.doc_id, r.doc_tokens) for r in b}
