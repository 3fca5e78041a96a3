"""A keyed table of layers: commits write what changed, reads merge, compaction folds the changes in.

A table is a folder. ``data`` holds one folder a commit, parted by bucket of the key; ``_versions`` holds a small manifest
a version, which names the layers that make the table up, oldest first. A commit is the appearance of its manifest, by a
rename that fails where the name is taken; what a broken commit has written is named by none and is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

from ..functions import vectors


class Conflict(RuntimeError):
    """Another commit came first, and this one had read the table."""


def first_of(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """One row a key, the first by ``order``; what is equal there is taken by its columns' hash, so reruns agree. Combines
    before the shuffle, so a key may hold any share of the rows."""
    everything = F.struct(*rows.columns)
    best = rows.groupBy(F.col(key).alias("_key")).agg(F.min_by(everything, F.struct(*order, F.xxhash64(*(F.to_json(F.struct(c)) for c in rows.columns)))).alias("_row"))
    return best.select("_row.*")


class VersionedTable:
    """Rows of one schema, unique by ``key``. Null keys are refused.

    buckets: parts of a commit by the key's hash, so that compaction may take some of them; deltas: layers of changes that
    may lie on the compacted ones before a commit compacts the table.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_uid", buckets: int = 16, deltas: int = 8) -> None:
        self.spark, self.path, self.key, self.buckets, self.deltas = spark, path.rstrip("/"), key, buckets, deltas

    # --- manifests ---

    def _where(self, name: str):  # noqa: ANN202
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        where, fs = self._where("_versions")
        if not fs.exists(where):
            return []
        return sorted(int(n[:-5]) for n in (s.getPath().getName() for s in fs.listStatus(where)) if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            return {"version": 0, "layers": [], "schema": None, "batches": {}, "note": ""}
        where, fs = self._where(f"_versions/{known[-1] if version is None else version:012d}.json")
        stream = fs.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Make a manifest visible under its number, or fail where there is one."""
        final, fs = self._where(f"_versions/{manifest['version']:012d}.json")
        draft, _ = self._where(f"_versions/{uuid.uuid4().hex}.draft")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(draft, final, options)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise Conflict(f"version {manifest['version']} is taken") from e
            raise

    # --- layers ---

    def _write(self, rows: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        checked = rows.withColumn("_bucket", F.when(F.col(self.key).isNull(), F.raise_error(F.lit(f"null {self.key}"))).otherwise(bucket))
        checked.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        return name

    def _layers(self, manifest: dict, delta: bool) -> DataFrame | None:
        """All rows of the compacted layers, or of the changes with ``_gone`` and the layer's place as ``_seq``."""
        schema = StructType.fromJson(manifest["schema"]).add("_gone", BooleanType()).add("_bucket", IntegerType())
        found = None
        for seq, layer in enumerate(manifest["layers"]):
            if layer["delta"] == delta:
                rows = self.spark.read.schema(schema).parquet(f"{self.path}/{layer['dir']}").filter(F.col("_bucket").isin(layer["buckets"]))
                rows = rows.withColumn("_seq", F.lit(seq)) if delta else rows.drop("_gone")
                found = rows if found is None else found.unionByName(rows)
        return found

    def _merged(self, manifest: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        part = lambda df: df if df is None or buckets is None else df.filter(F.col("_bucket").isin(list(buckets)))
        base, changes = part(self._layers(manifest, False)), part(self._layers(manifest, True))
        names = StructType.fromJson(manifest["schema"]).fieldNames()
        if changes is None:
            return base.select(*names)
        last = changes.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(F.struct(*names, "_gone"), "_seq").alias("_row"))
        now = last.filter("not _row._gone").select(*(F.col("_row")[n].alias(n) for n in names))
        if base is None:
            return now
        return base.join(last.select(F.col("_key").alias(self.key)), self.key, "left_anti").select(*names).unionByName(now)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the latest without one. Changes that are few are broadcast, so the compacted rows are
        not shuffled."""
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            raise ValueError(f"no table in {self.path}")
        return self._merged(manifest)

    # --- commits ---

    def _change(self, note: str, make: Callable[[dict], DataFrame], blind: bool, batch: tuple[str, int] | None = None, state: dict | None = None) -> int:
        """Commit the rows (with ``_gone``) that ``make`` derives from the state. A change that did not read the state goes
        on top of whatever came first; others, on ``state`` where one is given, are refused then."""
        manifest = state or self.manifest()
        if batch and manifest["batches"].get(batch[0], -1) >= batch[1]:
            return manifest["version"]  # was committed before
        rows = make(manifest)
        schema = StructType([f for f in rows.schema.fields if f.name != "_gone"])
        known = manifest["schema"] and StructType.fromJson(manifest["schema"])
        if known and [(f.name, f.dataType) for f in known] != [(f.name, f.dataType) for f in schema]:
            raise ValueError(f"columns are {schema.simpleString()}, the table has {known.simpleString()}")
        first = not manifest["layers"]
        layer = {"dir": self._write(rows.filter("not _gone").drop("_gone") if first else rows), "delta": not first, "buckets": list(range(self.buckets))}
        while True:
            if batch:
                manifest["batches"][batch[0]] = batch[1]
            manifest |= {"version": manifest["version"] + 1, "note": note, "layers": [*manifest["layers"], layer], "schema": manifest["schema"] or json.loads(schema.json())}
            try:
                self._commit(manifest)
                break
            except Conflict:
                if not blind or first:
                    raise
                manifest = self.manifest()
        if sum(x["delta"] for x in manifest["layers"]) > self.deltas:
            self.compact()
        return self.versions()[-1]

    def upsert(self, rows: DataFrame, *order: Column | str, unseen: str | None = None, dimension: tuple[str, int] | None = None, batch: tuple[str, int] | None = None) -> int:
        """Insert rows or put them in place of those of their key; gives the version.

        Of several rows of a key the first by ``order`` is taken. unseen: a column (a content's hash) whose stored values
        make a row superfluous. dimension: a column of vectors and their length; other lengths are refused row by row.
        batch: name and number of a stream's batch; one that was committed is not committed again.
        """
        def make(manifest: dict) -> DataFrame:
            new = rows if dimension is None else rows.filter(vectors.has_dimension(*dimension))
            if unseen and manifest["schema"]:
                new = new.join(self._merged(manifest).select(unseen).distinct(), unseen, "left_anti").select(*rows.columns)
            return first_of(new, self.key, *order).withColumn("_gone", F.lit(False))

        return self._change("upsert", make, blind=unseen is None, batch=batch)

    def delete(self, keys: DataFrame, insert: DataFrame | None = None, *order: Column | str, state: dict | None = None) -> int:
        """Delete the rows of ``keys`` and, in the same commit, insert others."""
        def make(manifest: dict) -> DataFrame:
            names = StructType.fromJson(manifest["schema"]).fields
            gone = keys.select(self.key).distinct()
            new = None if insert is None else first_of(insert, self.key, *order).withColumn("_gone", F.lit(False))
            if new is not None:
                gone = gone.join(new.select(self.key), self.key, "left_anti")
            marks = gone.select(*(F.col(f.name) if f.name == self.key else F.lit(None).cast(f.dataType).alias(f.name) for f in names), F.lit(True).alias("_gone"))
            return marks if new is None else new.select(*marks.columns).unionByName(marks)

        return self._change("delete", make, blind=state is None, state=state)

    def replace(self, column: str, rows: DataFrame, *order: Column | str) -> int:
        """Put ``rows`` in place of all rows whose ``column`` (a law, say) has one of their values, in one commit."""
        state = self.manifest()
        old = self._merged(state).join(rows.select(column).distinct(), column, "left_semi").select(self.key)
        return self.delete(old, rows, *order, state=state)

    def compact(self, buckets: Sequence[int] | None = None) -> int:
        """Fold the changes of some buckets, or of all, into a new layer; the others keep theirs."""
        state = self.manifest()
        which = list(range(self.buckets)) if buckets is None else sorted(buckets)
        name = self._write(self._merged(state, which))
        kept = [{**x, "buckets": [b for b in x["buckets"] if b not in which]} for x in state["layers"]]
        kept = [{"dir": name, "delta": False, "buckets": which}, *(x for x in kept if x["buckets"])]
        self._commit(state | {"version": state["version"] + 1, "note": "compact", "layers": kept})
        return state["version"] + 1

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove what none of the last ``keep`` versions names, broken commits' folders included. Not while others write."""
        known = self.versions()
        used = {x["dir"] for v in known[-keep:] for x in self.manifest(v)["layers"]}
        where, fs = self._where("data")
        gone = [f"data/{s.getPath().getName()}" for s in fs.listStatus(where) if f"data/{s.getPath().getName()}" not in used]
        for name in [*gone, *(f"_versions/{v:012d}.json" for v in known[:-keep])]:
            fs.delete(self._where(name)[0], True)
        return gone
