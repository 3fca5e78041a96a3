"""The versioned table: commits, conflicts, merges, compaction; ingest by stream; the stored vector index."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import retrieval, store, vector_index
from quillspark.operators.versioned import Conflict, VersionedTable
from quillspark.plans import search
from quillspark.sources.scratch import scratch
from quillspark.streaming import streams
from tests.conftest import SF


def rows(spark, *values):
    return spark.createDataFrame(list(values), "uid string, law string, n int")


def state(table, version=None):
    return sorted(tuple(r) for r in table.read(version).collect())


@pytest.fixture
def table(spark):
    return VersionedTable(spark, scratch(spark, "store"), "uid", buckets=4)


def test_commits_merge_and_compaction_changes_nothing(spark, table):
    assert table.upsert(rows(spark, ("a", "x", 1), ("b", "x", 1), ("c", "y", 1), ("c", "y", 0)), "n") == 1
    assert state(table) == [("a", "x", 1), ("b", "x", 1), ("c", "y", 0)]
    table.upsert(rows(spark, ("b", "y", 2), ("d", "y", 2), ("d", "y", 3)), "n")
    table.delete(rows(spark, ("a", "", 0), ("z", "", 0)))
    now = [("b", "y", 2), ("c", "y", 0), ("d", "y", 2)]
    assert state(table) == now
    for some in ([0, 2], None):
        table.compact(some)
        assert state(table) == now
    assert state(table, 1) == [("a", "x", 1), ("b", "x", 1), ("c", "y", 0)]  # as of the first commit
    table.replace("law", rows(spark, ("e", "y", 9), ("b", "y", 9)))
    assert state(table) == [("b", "y", 9), ("e", "y", 9)]
    assert table.vacuum() and state(table) == [("b", "y", 9), ("e", "y", 9)] and table.vacuum() == []


def test_a_broken_commit_is_invisible_and_a_taken_version_is_refused(spark, table, monkeypatch):
    table.upsert(rows(spark, ("a", "x", 1)))
    monkeypatch.setattr(table, "_commit", lambda manifest: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        table.upsert(rows(spark, ("a", "x", 2)))
    monkeypatch.undo()
    assert state(table) == [("a", "x", 1)] and table.versions() == [1]
    old = table.manifest()
    table.upsert(rows(spark, ("b", "x", 2)))
    with pytest.raises(Conflict):
        table._commit(old | {"version": 2})
    with pytest.raises(Conflict):  # what has read the old state may not commit on top of the new one
        table.delete(rows(spark, ("a", "", 0)), state=old)
    table._change("upsert", lambda _: rows(spark, ("c", "x", 3)).withColumn("_gone", F.lit(False)), blind=True, state=None)
    assert [r[0] for r in state(table)] == ["a", "b", "c"]


def test_a_blind_upsert_goes_on_top_of_another(spark, table, monkeypatch):
    table.upsert(rows(spark, ("a", "x", 1)))
    other, first = VersionedTable(spark, table.path, "uid", buckets=4), []
    write = table._write

    def write_late(df):
        name = write(df)
        if not first:
            first.append(other.upsert(rows(spark, ("b", "x", 2), ("a", "x", 2))))
        return name

    monkeypatch.setattr(table, "_write", write_late)
    table.upsert(rows(spark, ("a", "x", 3)))
    assert state(table) == [("a", "x", 3), ("b", "x", 2)]


def test_batches_commit_once_and_layers_stay_few(spark, table):
    table.deltas = 3
    for n in range(6):
        table.upsert(rows(spark, ("a", "x", n), (str(n), "x", n)), batch=("s", n))
        table.upsert(rows(spark, ("a", "x", 99)), batch=("s", n))  # the same batch again
    assert len(state(table)) == 7 and ("a", "x", 5) in state(table)
    assert sum(x["delta"] for x in table.manifest()["layers"]) <= 3


def test_refusals(spark, table):
    table.upsert(rows(spark, ("a", "x", 1)))
    with pytest.raises(Exception, match="null uid"):
        table.upsert(rows(spark, (None, "x", 1)))
    with pytest.raises(ValueError, match="columns"):
        table.upsert(spark.createDataFrame([("a", 1)], "uid string, n int"))
    with pytest.raises(ValueError, match="no table"):
        VersionedTable(spark, scratch(spark, "none")).read()
    assert state(table) == [("a", "x", 1)]


def test_upserts_write_what_changed(spark, table):
    table.upsert(rows(spark, *((f"u{i}", "x", i) for i in range(5000))))
    table.upsert(rows(spark, ("u7", "x", -7)))
    data = [spark.read.parquet(f"{table.path}/{x['dir']}").count() for x in table.manifest()["layers"]]
    assert data == [5000, 1] and table.read().count() == 5000
    plan = table.read()._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan  # the large layer is not shuffled for a small change


def test_snapshot_upsert_keeps_uids_unique(spark):
    kept = rows(spark, ("a", "x", 1))
    new = rows(spark, ("a", "x", 3), ("a", "x", 2), ("b", "y", 1), ("b", "y", 1)).withColumn("v", F.array_repeat(F.lit(1.0), F.col("n")))
    got = store.upsert(kept, new, "uid", ["n"])
    assert sorted(map(tuple, got.collect())) == [("a", "x", 2), ("b", "y", 1)]
    assert sorted(map(tuple, store.upsert(kept, new, "uid", ["n"], dimension=("v", 3)).collect())) == [("a", "x", 3)]


def test_first_edge_wins(spark):
    e = spark.createDataFrame([("a", "b", "t", 0.5, 1), ("a", "b", "t", 0.9, 2), ("c", "d", "t", 0.1, 0)], "source_chunk_uid string, target_chunk_uid string, relation_type string, confidence double, at int")
    assert sorted(tuple(r) for r in store.append_edges(e.filter("at = 0"), e, "at").collect()) == [("a", "b", "t", 0.5)]
    assert store.append_edges(e.filter("at = 0"), e).first()["confidence"] == 0.9


def test_file_names(spark):
    names = ["Informe-Nº 3_final", "  ", None, "Año ﬁn é", "__x__", "日本"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(T.slug(F.col("n"))).collect()]
    assert got == ["Informe-No_3_final", "documento", "documento", "Ano_fin_e", "x", "documento"]


def test_markdown_stream_keeps_each_content_once(spark, tmp_path):
    record = lambda ident, body, law="": f"## Metadata\n- jurisprudencia_id: {ident}\n- law_tag: {law}\n- estado: vigente\n\n## Resumen\n.\n\n## Contenido\n{body}\n"
    files, log = tmp_path / "files", f"file://{tmp_path}/log"
    table = VersionedTable(spark, f"file://{tmp_path}/store")
    run = lambda: streams.ingest_files(spark, f"file://{files}", "sii_pron_*.md", table, log, "sii_judicial_", laws=[("iva", ["impuesto"])])
    (files / "a").mkdir(parents=True)
    (files / "a/sii_pron_1.md").write_text(record("1", "one"))
    (files / "a/sii_pron_2.md").write_text(record("", "impuesto two"))
    (files / "a/sii_pron_3.md").write_text("no sections")
    (files / "a/other.md").write_text(record("4", "four"))
    run()
    assert sorted((r["chunk_uid"], r["law_tag"], r["batch"]) for r in table.read().collect()) == [("sii_judicial_1", "ley", 0), ("sii_judicial_2", "iva", 0)]
    (files / "b").mkdir()
    (files / "b/sii_pron_9.md").write_text(record("9", "one"))  # seen under another name
    (files / "b/sii_pron_5.md").write_text(record("5", "five", "lir"))
    run()
    run()  # nothing new
    got = {r["chunk_uid"]: r for r in table.read().collect()}
    assert set(got) == {"sii_judicial_1", "sii_judicial_2", "sii_judicial_5"}
    assert got["sii_judicial_5"]["law_tag"] == "lir" and got["sii_judicial_5"]["content"] == "Contenido:\nfive" and got["sii_judicial_5"]["batch"] == 1
    assert len(table.versions()) <= 3


def test_context_ends_in_date_instance_and_document(spark):
    headed = spark.createDataFrame([(1, 1, "[1]", " a\n\n\n\nb ", {"fecha": "2024-01-02", "instancia": "x", "pdf_url": "N/A"}), (1, 2, "[2]", "c", {"fecha": "", "pdf_url": "u"}), (1, 3, "[3]", "d", None)], "query_id int, i int, header string, content string, metadata map<string,string>")
    got = retrieval.build_context(headed.select("query_id").distinct(), headed).first()["context"]
    line = "-" * 60
    assert got == f"[1]\n{line}\na\n\nb\n  → Fecha: 2024-01-02 | Instancia: x\n\n[2]\n{line}\nc\n  → PDF: u\n\n[3]\n{line}\nd\n"


def test_stored_lists_find_nine_in_ten_and_read_few(spark):
    """On all vectors of sf0.1: recall, what is read, and a second search and an addition without a fit."""
    big = SF.replace("0.001", "0.1")
    path, c, asking = scratch(spark, "index"), search._answering(spark, big), search._asking(spark, big)
    later = F.pmod(F.crc32("uid"), F.lit(5)) == 0
    vector_index.build_index(c.filter(~later), path)
    vector_index.add_vectors(c, path)
    vector_index.add_vectors(c.limit(50), path)  # all known
    assert spark.read.parquet(f"{path}/lists").count() == c.count()
    exact = {(r.query_id, r.uid) for r in retrieval.match_chunks(asking, c).collect()}
    near = {(r.query_id, r.uid): r.similarity for r in vector_index.search_index(asking, path).collect()}
    assert len(exact & set(near)) >= 0.9 * len(exact)
    cost = vector_index.search_cost(asking, path)
    assert cost["whole"] <= 0.15 and cost["bytes"] <= 0.15 and cost["codes"] < 1
    again = {(r.query_id, r.uid): r.similarity for r in vector_index.search_index(asking, path).collect()}
    assert again == near


def test_index_edges(spark):
    path = scratch(spark, "index")
    c = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", None), ("d", [0.0, 0.0, 0.0]), ("e", [1.0, 2.0]), ("f", [0.9, 0.1, 0.0])], "uid string, embedding array<float>")
    vector_index.build_index(c, path, lists=2)
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [1.0]), (3, None)], "query_id long, embedding array<float>")
    got = [(r.query_id, r.uid, r.similarity) for r in vector_index.search_index(q, path, 2, probes=2).orderBy(F.desc("similarity")).collect()]
    assert got == [(1, "a", 1.0), (1, "f", 0.993884)]
    assert vector_index.search_index(q.filter("query_id = 2"), path).count() == 0


def test_codes_round_trip():
    import numpy as np

    draw = np.random.default_rng(0).normal(size=(50, 7)) / 3
    back = vector_index.decode(vector_index.encode(draw, 1.2), 7, 1.2)
    assert np.abs(back - np.clip(draw, -1.2, 1.2)).max() <= 1.2 / 15 + 1e-6
