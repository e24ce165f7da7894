"""A store of several tables whose changes are seen together or not at all.

Rows lie in Parquet folders that are never changed.  A change first stages its
folders, which nobody sees, and then writes one manifest: the list of all folders
with the version that added them.  The manifest's name is its version and is
created once, so of two writers one fails.  Deleted keys are rows of their own,
and count for what older versions added; a read leaves those rows out.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.tables import shared_path


class Conflict(RuntimeError):
    """Another writer has committed since this change began."""


class Store:
    """Tables by name, each with key columns; ``path`` is a folder that all executors see."""

    def __init__(self, spark: SparkSession, keys: dict[str, list[str]], path: str | None = None) -> None:
        self.spark, self.keys = spark, keys
        self.path = path or shared_path(spark, "store")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """All committed versions, from 1."""
        return [v for v in self._names() if self._manifest(v) is not None]

    def _names(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def _manifest(self, version: int) -> dict | None:
        """A version's folders; null for a manifest whose writer died over it."""
        stream = self._fs.open(self._path(f"{self.path}/manifests/{version:012d}.json"))
        try:
            said = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(said)
        except ValueError:
            return None

    def latest(self) -> int:
        """The last committed version, 0 for an empty store."""
        return max(self.versions(), default=0)

    def stage(self, rows: DataFrame, table: str, kind: str = "rows", most: int = 0) -> dict:
        """Write rows, or keys to delete, that no read sees before they are committed; files have ``most`` rows if that isn't 0."""
        if missing := set(self.keys[table]) - set(rows.columns):
            raise ValueError(f"{table} lacks the key columns {sorted(missing)}")
        path = f"{self.path}/data/{table}-{kind}-{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", most).parquet(path)
        return {"table": table, "kind": kind, "path": path, "schema": rows.schema.json()}

    def commit(self, staged: list[dict], since: int) -> int:
        """Make staged folders part of the store as the version after ``since``; fails with Conflict if that one is taken.

        Deletions of a commit count for what earlier versions added, not for its own rows.
        """
        version = max([since, *self._names()]) + 1
        if self.latest() != since:
            raise Conflict(f"version {since} isn't the last one")
        before = self._manifest(since)["folders"] if since else []
        said = json.dumps({"version": version, "folders": before + [s | {"version": version} for s in staged]})
        try:
            stream = self._fs.create(self._path(f"{self.path}/manifests/{version:012d}.json"), False)
        except Exception as error:
            raise Conflict(f"version {version} was taken") from error
        stream.write(bytearray(said.encode()))
        stream.close()
        return version

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """The rows of a table as of a version, the last one if none is named; null if it never had any."""
        version = self.latest() if version is None else version
        folders = [f for f in (self._manifest(version)["folders"] if version else []) if f["table"] == table]
        data = [f for f in folders if f["kind"] == "rows"]
        if not data:
            return None
        gone = [f for f in folders if f["kind"] == "keys"]
        # What came with the last deletions or after them is there as a whole, without a join.
        last_gone = max((f["version"] for f in gone), default=0)
        older, whole = [[self._folder(f) for f in data if (f["version"] < last_gone) == o] for o in (True, False)]
        if older:
            keys = self.keys[table]
            rows = _united(older)
            # Deletions count for rows of older versions only, so those up to the oldest rows delete nothing.
            oldest = min(f["version"] for f in data)
            gone = [f for f in gone if f["version"] > oldest]
            last = reduce(DataFrame.unionByName, (self._folder(f).select(*keys, "_version") for f in gone)).groupBy(*keys).agg(F.max("_version").alias("_gone"))
            same = reduce(Column.__and__, (rows[k].eqNullSafe(last[k]) for k in keys))
            older = [rows.join(last, same & (rows["_version"] < last["_gone"]), "left_anti")]
        return _united([*older, *whole]).drop("_version")

    def _folder(self, folder: dict) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(folder["schema"]))
        return self.spark.read.schema(schema).parquet(folder["path"]).withColumn("_version", F.lit(folder["version"]).cast("long"))

    def upsert(self, table: str, rows: DataFrame) -> int:
        """Rows in place of those with the same keys; of rows with one key within ``rows`` all stay."""
        since = self.latest()
        staged = [self.stage(rows, table)]
        keys = self._folder(staged[0] | {"version": 0}).select(*self.keys[table]).distinct()
        return self.commit([*staged, self.stage(keys, table, "keys")], since)

    def delete(self, table: str, where: Column, page: int = 1000) -> tuple[int, int]:
        """(rows, pages): delete what a filter finds; the keys are written in pages of so many and take effect together."""
        since = self.latest()
        rows = self.read(table)
        if rows is None:
            return 0, 0
        # All rows of a key go, as a key is what is deleted.
        staged = self.stage(rows.where(where).select(*self.keys[table]), table, "keys", page)
        n = self.spark.read.parquet(staged["path"]).count()
        if n:
            self.commit([staged], since)
        return n, -(-n // page)

    def compact(self, table: str) -> int:
        """Rewrite a table without its deleted rows; older versions stay readable."""
        since = self.latest()
        rows = self.read(table)
        if rows is None:
            return since
        staged = self.stage(rows, table)
        version = max([since, *self._names()]) + 1
        if self.latest() != since:
            raise Conflict(f"version {since} isn't the last one")
        others = [f for f in self._manifest(since)["folders"] if f["table"] != table]
        stream = self._fs.create(self._path(f"{self.path}/manifests/{version:012d}.json"), False)
        stream.write(bytearray(json.dumps({"version": version, "folders": [*others, staged | {"version": version}]}).encode()))
        stream.close()
        return version


def _united(folders: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), folders)


def chunk_store(spark: SparkSession, path: str | None = None) -> Store:
    """A library's items by item_id, and their chunks by item_id and chunk_index."""
    return Store(spark, {"items": ["item_id"], "chunks": ["item_id", "chunk_index"]}, path)


def ingest_chunks(store: Store, chunks: DataFrame, vectors: DataFrame | None = None, width: int | None = None) -> int:
    """Chunks (item_id, chunk_index and others) become those of their items in place of older ones, and the items ready: one commit.

    ``vectors`` (item_id, chunk_index, embedding) must have one row for each chunk and no other, all of one length (of
    ``width`` if given); else a ValueError tells what differs, and nothing is seen.  Returns the number of chunks.
    """
    key = ["item_id", "chunk_index"]
    since = store.latest()
    if vectors is not None:
        both = chunks.select(*key, F.lit(1).alias("_c")).unionByName(vectors.select(*key, F.lit(0).alias("_c")))
        odd = both.groupBy(*key).agg(F.sum("_c").alias("c"), F.count("*").alias("n")).where("c != 1 or n != 2").count()
        if odd:
            raise ValueError(f"{odd} chunks and vectors have no single partner")
        sizes = vectors.agg(F.min(F.coalesce(F.size("embedding"), F.lit(-1))).alias("a"), F.max(F.coalesce(F.size("embedding"), F.lit(-1))).alias("b")).first()
        if sizes.a is not None and (sizes.a != sizes.b or sizes.a < 1 or width not in (None, sizes.a)):
            raise ValueError(f"vectors have from {sizes.a} to {sizes.b} numbers" + (f", not {width}" if width else ""))
        chunks = chunks.join(vectors.select(*key, "embedding"), key)
    rows = store.stage(chunks, "chunks")
    staged = store._folder(rows | {"version": 0}).drop("_version")
    items = staged.groupBy("item_id").agg(F.count("*").alias("chunks"))
    ready = store.stage(items.select("item_id", "chunks", F.lit("ready").alias("status")), "items")
    changes = [rows, ready, store.stage(items.select("item_id"), "items", "keys")]
    old = store.read("chunks")
    if old is not None:
        changes.append(store.stage(old.select(*key).join(items.select("item_id"), "item_id", "left_semi").distinct(), "chunks", "keys"))
    store.commit(changes, since)
    return staged.count()


def update_vectors(store: Store, vectors: DataFrame) -> int:
    """New vectors (item_id, chunk_index, embedding) for chunks that are there; returns how many had one."""
    key = ["item_id", "chunk_index"]
    old = store.read("chunks")
    if old is None:
        return 0
    fresh = old.drop("embedding").join(vectors.select(*key, "embedding"), key)
    since = store.latest()
    rows = store.stage(fresh, "chunks")
    written = store._folder(rows | {"version": 0})
    store.commit([rows, store.stage(written.select(*key).distinct(), "chunks", "keys")], since)
    return written.count()
