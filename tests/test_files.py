"""The data source of whole files: reasons, groups of files, trees and their defaults."""

import json

import pytest

from quillspark.operators import trees
from quillspark.operators.versioned import VersionedTable
from quillspark.sources import files as files_module
from quillspark.sources.files import RecordReader, RecordStream, parted, read_files, write_files
from quillspark.sources.readers import markdown_records, read_tree_files
from quillspark.streaming import streams

TREE = {"tree_id": "a", "title": "A", "law": "l", "article": "1", "description": "", "root": {"branches": [{"condition": "c", "next_node": "x"}]}, "nodes": {"x": {"type": "result"}}}


def put(folder, files):
    for name, content in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(folder)


def test_reasons(spark, tmp_path):
    path = put(tmp_path, {
        "sii_pron_1.md": "## Contenido\nñandú", "sub/sii_pron_2.md": b"ab\xff", "sub/sii_pron_3.md": " \n", "sub/deep/sii_pron_4.md": "", "other.md": "x", "sub/sii_pron_5.txt": "x",
    })
    files = read_files(spark, path, "sii_pron_*.md")
    got = {r.path[len(path) + 1 :]: (r.size, r.content, r.reason) for r in files.collect()}
    assert got == {
        "sii_pron_1.md": (20, "## Contenido\nñandú", None), "sub/sii_pron_2.md": (3, None, "not UTF-8 at byte 2"),
        "sub/sii_pron_3.md": (2, " \n", "empty"), "sub/deep/sii_pron_4.md": (0, "", "empty"),
    }
    good, rejected = parted(files)
    assert [r.chunk_uid for r in markdown_records(good, "ruling_", r"_([0-9]+)\.md$").collect()] == ["ruling_1"] and rejected.count() == 3
    assert read_files(spark, f"file://{path}/sub", "*.md").count() == 3 and read_files(spark, f"{path}/none").count() == 0
    with pytest.raises(ValueError):
        RecordReader({"path": path, "format": "csv"})


def test_small_files_share_tasks(spark, tmp_path):
    path = put(tmp_path, {f"{i % 7}/f{i:03d}.txt": "x" * (i % 5 + 1) for i in range(300)} | {"big/f999.txt": "y" * 5000})
    assert read_files(spark, path).rdd.getNumPartitions() == 1
    for options in ({"partitionFiles": 50}, {"partitionBytes": 200}, {"partitionFiles": 1}):
        files = read_files(spark, path, "f*.txt", **options)
        assert len({r.path for r in files.collect()}) == files.count() == 301
    groups = RecordReader({"path": path, "partitionFiles": "50"}).partitions()
    assert len(groups) == 7 and max(len(g.folders) for g in groups) <= 3
    sizes = [sum(len(b.column("path")) for b in RecordReader({"path": path, "partitionBytes": "200"}).read(g)) for g in RecordReader({"path": path, "partitionBytes": "200"}).partitions()]
    assert sum(sizes) == 301 and 1 in sizes  # the large file is alone


def test_tree_files(spark, tmp_path):
    lacking = {k: v for k, v in TREE.items() if k not in ("law", "article")}
    path = put(tmp_path, {
        "a/1.json": json.dumps(TREE | {"title": "older"}), "b/1.json": json.dumps(TREE), "b/2.json": "{", "b/3.json": json.dumps(lacking), "b/4.json": "[1]",
        "b/5.json": json.dumps(TREE | {"tree_id": None}), "b/6.json": json.dumps(TREE | {"root": 3}), "b/7.json": "[" * 100_000, "_drafts/1.json": json.dumps(TREE | {"tree_id": "draft"}),
    })
    good, rejected = read_tree_files(spark, path)
    assert [(r.tree_id, r.title) for r in good.collect()] == [("a", "A")]
    reasons = {r.path[-6:-5]: r.reason for r in rejected.collect()}
    assert reasons.pop("2").startswith("not JSON: ") and reasons.pop("7").startswith("not JSON: ")
    assert reasons == {"3": "missing: law, article", "4": "not an object", "5": "missing: tree_id", "6": "not a tree"}
    assert {r.tree_id for r in read_tree_files(spark, path, drafts=True)[0].collect()} == {"a", "draft"}
    nodes = trees.node_table(good)
    assert {(r.node_id, r.is_root, r.type) for r in nodes.collect()} == {("root", True, "decision"), ("x", False, "result")}
    cases = spark.sql("select 1 as case_id, 'a' as tree_id, map('c', 'true') as facts")
    assert trees.walk(cases, nodes).first().path == ["root", "x"]


def test_rows_become_files(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(f"text {i} ñ" if i else None,) for i in range(2500)], "value string").repartition(2)
    write_files(rows, f"file://{tmp_path}/out")
    got = read_files(spark, f"{tmp_path}/out", "part-*.txt", partitionFiles=700)
    assert sorted(r.content for r in got.collect()) == sorted(["", *(f"text {i} ñ" for i in range(1, 2500))])
    assert max(len(list(f.iterdir())) for f in (tmp_path / "out").glob("*/*")) <= 1000  # no folder holds them all
    with pytest.raises(Exception, match="one column"):
        write_files(rows.withColumn("more", rows["value"]), f"{tmp_path}/out")


def test_a_shared_folder_is_listed_once(tmp_path, monkeypatch):
    path = put(tmp_path, {f"f{i:03d}.txt": "x" for i in range(100)})
    groups = RecordReader({"path": path, "partitionFiles": "10"}).partitions()
    monkeypatch.setattr(files_module, "listing", lambda *_: pytest.fail("listed again by a task"))
    assert sum(b.num_rows for g in groups for b in RecordReader({"path": path}).read(g)) == 100


def test_stream_lists_each_file_once(tmp_path):
    """Listings lie in files in order of the folders: new names, a line a task, and all names, a line a folder."""
    files = tmp_path / "files"
    add = lambda name, content="x": put(files, {name: content})
    stream = lambda: RecordStream({"path": f"file://{files}", "pattern": "*.md", "listings": f"file://{tmp_path}/log/listings", "partitionFiles": "2", "invalid": "replace"})
    read = lambda a, b: [[(r["path"].rpartition("files/")[2], r["content"]) for t in stream().read(p) for r in t.to_pylist()] for p in stream().partitions({"listing": a}, {"listing": b})]
    assert stream().latestOffset() == stream().initialOffset() == {"listing": 0}
    for name in ("2.md", "a/1.md", "a/b/1.md", "a-b/1.md", "_draft/1.md", "a/_1.md", "a/.1.md", "a/1.txt"):
        add(name, name)
    assert stream().latestOffset() == {"listing": 1} == stream().latestOffset()
    first = read(0, 1)
    assert [len(task) for task in first] == [2, 2] and sorted(sum(first, [])) == [(n, n) for n in ("2.md", "a-b/1.md", "a/1.md", "a/b/1.md")]
    (files / "a/b/1.md").unlink()
    (files / "a/b").rmdir()
    add("a/1.md", "changed")
    add("1.md", b"\xff")
    add("a/a/1.md")
    assert stream().latestOffset() == {"listing": 2}  # and the run breaks off before its batch
    add("a/b/1.md", "again")
    add("z/1.md")
    assert stream().latestOffset() == {"listing": 3} == stream().latestOffset()
    assert sorted(sum(read(1, 3), [])) == [("1.md", "�"), ("a/a/1.md", "x"), ("z/1.md", "x")]
    (files / "z/1.md").unlink()
    assert [t.column("reason")[0].as_py()[:10] for p in stream().partitions({"listing": 2}, {"listing": 3}) for t in stream().read(p)] == ["unreadable"]


def test_ingest_keeps_no_names_in_the_log_of_the_driver(spark, tmp_path):
    """Spark's own file stream keeps an entry a file, which the driver holds; and a task a few dozen files."""
    for k in range(300):
        (tmp_path / f"files/{k // 100}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"files/{k // 100}/n_{k}.md").write_text(f"## Contenido\ntext {k % 250}\n")
    store = VersionedTable(spark, f"file://{tmp_path}/store")
    streams.ingest_files(spark, f"{tmp_path}/files", "n_*.md", store, f"{tmp_path}/log", "p_")
    rows = store.read().collect()
    assert {r["content"] for r in rows} == {f"Contenido:\ntext {k}" for k in range(250)} and len(rows) == 250
    assert all(r["source_path"] == f"file://{tmp_path}/files/{int(r['filename'][2:-3]) // 100}/{r['filename']}" for r in rows)
    assert not any("n_1.md" in f.read_text() for part in ("sources", "offsets", "commits") for f in (tmp_path / "log" / part).rglob("*") if f.is_file() and f.suffix != ".crc")
