"""Tables in buckets under one manifest: upserts rewrite the touched buckets only, several tables change in one commit.

A store is a folder with member tables. Every member is dealt into the same number of buckets by a hash of its first key, so rows
of one entity stand in buckets of one number in all members. A version of the store is a manifest, a small JSON file that names
the folder of every bucket of every member; data folders are written first and never changed. A commit creates the manifest of
the next number, which fails if it is there: of two writers one wins. The other takes the winner's version and, where the winner
left its buckets alone, commits its folders as they are; else it works anew (`change` does so). Readers see the last whole
version. `vacuum` deletes old manifests and the folders that no kept one names.

Manifests are created by a rename that fails on an existing target (a link on local disks), atomic on HDFS and local disks; a
store on an object store needs one that has this.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer has committed this version."""


@dataclass
class Manifest:
    """version; of each member its schema (JSON) and the folder of each bucket that has rows; the last batch of each stream."""

    version: int = 0
    schemas: dict[str, str] = field(default_factory=dict)
    folders: dict[str, dict[str, str]] = field(default_factory=dict)
    done: dict[str, int] = field(default_factory=dict)


@dataclass
class Change:
    """Rows that replace the named buckets of a member; buckets without rows become empty."""

    rows: DataFrame
    key: str
    buckets: Sequence[int]


class ManifestLog:
    """Numbered JSON files under `path`/_manifest; a number is created once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def fs(self):
        """Hadoop's classes and the file system of the path."""
        jvm = self.spark._jvm
        return jvm, jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def file(self, version: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifest/{version:020d}.json")

    def versions(self) -> list[int]:
        jvm, store = self.fs()
        found = store.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifest/[0-9]*.json")) or []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in found)

    def read(self, version: int) -> dict:
        jvm, store = self.fs()
        stream = store.open(self.file(version))
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, version: int, content: dict) -> None:
        """Write the whole file aside, then move it to its number; Conflict if that is taken."""
        jvm, store = self.fs()
        own, target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifest/.{uuid.uuid4().hex}"), self.file(version)
        store.mkdirs(own.getParent())
        stream = store.create(own, False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        try:
            if store.getScheme() == "file":
                os.link(own.toUri().getPath(), target.toUri().getPath())
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), self.spark._jsc.hadoopConfiguration()).rename(own, target, none)
        except FileExistsError as error:
            raise Conflict(version) from error
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                raise Conflict(version) from error
            raise
        finally:
            store.delete(own, False)

    def keep_last(self, keep: int, named: Callable[[dict], set[str]]) -> int:
        """Delete all manifests but the last `keep`, and the folders under data/ that no kept one names; how many those were."""
        jvm, store = self.fs()
        found = self.versions()
        kept = set().union(*[named(self.read(v)) for v in found[-keep:]])
        for v in found[:-keep]:
            store.delete(self.file(v), False)
        gone = [s.getPath() for s in store.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/*")) or [] if f"data/{s.getPath().getName()}" not in kept]
        for p in gone:
            store.delete(p, True)
        return len(gone)


class BucketStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, spread: int = 4):
        """spread: files that a bucket may have, so that no bucket is written by one task."""
        self.spark, self.path, self.buckets, self.spread = spark, path.rstrip("/"), buckets, spread
        self.log = ManifestLog(spark, path)

    # --- the manifest

    def versions(self) -> list[int]:
        return self.log.versions()

    def manifest(self, version: int) -> Manifest:
        return Manifest(**self.log.read(version))

    def current(self) -> Manifest:
        found = self.versions()
        return self.manifest(found[-1]) if found else Manifest()

    # --- reading

    def bucket(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, key: str) -> list[int]:
        """The buckets that rows fall in: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket(key)).distinct().collect())

    def read(self, name: str, manifest: Manifest | None = None, buckets: Sequence[int] | None = None, schema: str | None = None) -> DataFrame:
        """A member, or some of its buckets; schema (DDL) is what an absent one has."""
        manifest = manifest or self.current()
        if name not in manifest.schemas:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        kind = StructType.fromJson(json.loads(manifest.schemas[name]))
        picked = [f"{self.path}/{f}" for b, f in sorted(manifest.folders[name].items()) if buckets is None or int(b) in set(buckets)]
        return self.spark.read.schema(kind).parquet(*picked) if picked else self.spark.createDataFrame([], kind)

    # --- writing

    def put(self, change: Change) -> dict[str, str | None]:
        """Write the rows of a change; the folder of each of its buckets, None for one that is empty now."""
        folder = f"data/{uuid.uuid4().hex}"
        rows = change.rows.withColumn("_bucket", self.bucket(change.key))
        rows.repartition("_bucket", F.pmod(F.xxhash64(*[c for c, kind in change.rows.dtypes if not kind.startswith(("map", "variant"))]), F.lit(self.spread))).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        jvm, store = self.log.fs()
        there = {s.getPath().getName().split("=")[1] for s in store.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}/_bucket=*")) or []}
        return {str(b): f"{folder}/_bucket={b}" if str(b) in there else None for b in change.buckets}

    def commit(self, base: Manifest, put: dict[str, tuple[StructType, dict[str, str | None]]], done: dict[str, int] | None = None) -> Manifest:
        """The version after base with folders written by put(); Conflict if there is one already."""
        new = Manifest(base.version + 1, dict(base.schemas), {k: dict(v) for k, v in base.folders.items()}, base.done | (done or {}))
        for name, (schema, folders) in put.items():
            new.schemas[name] = schema.json()
            own = new.folders.setdefault(name, {})
            for b, folder in folders.items():
                own.pop(b, None)
                if folder:
                    own[b] = folder
        self.log.create(new.version, new.__dict__)
        return new

    def change(self, work: Callable[[Manifest], dict[str, Change] | None], done: dict[str, int] | None = None, tries: int = 10) -> Manifest:
        """Commit what work makes of the current version. If another writer comes first: what this one has written counts on
        where the other left the same buckets (and the streams of `done`) alone; else work runs again. None changes nothing."""
        base = self.current()
        for _ in range(tries):
            changes = work(base)
            if changes is None:
                return base
            put = {name: (c.rows.schema, self.put(c)) for name, c in changes.items()}
            while True:
                try:
                    return self.commit(base, put, done)
                except Conflict:
                    newest = self.current()
                same = all(newest.folders.get(n, {}).get(b) == base.folders.get(n, {}).get(b) for n, (_, own) in put.items() for b in own)
                same = same and all(newest.done.get(s) == base.done.get(s) for s in done or {})
                same = same and all(newest.schemas.get(n) == base.schemas.get(n) for n in put)
                base = newest
                if not same:
                    break
        raise Conflict(f"{tries} tries")

    def upsert(self, name: str, updates: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> Manifest:
        """Rows of updates replace those of the same keys; new keys are added. The first key deals the buckets.

        order: of all rows of a key, old and new, the largest stays. Without it updates must have each key once."""
        buckets = self.touched(updates, keys[0])

        def work(base: Manifest) -> dict[str, Change] | None:
            if not buckets:
                return None
            old = self.read(name, base, buckets, schema=updates.schema)
            if order:
                both = old.unionByName(updates, allowMissingColumns=True)
                rest = [c for c in both.columns if c not in keys]
                best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
                rows = best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
            else:
                rows = old.join(updates.select(*keys), list(keys), "left_anti").unionByName(updates, allowMissingColumns=True)
            return {name: Change(rows, keys[0], buckets)}

        return self.change(work)

    def vacuum(self, keep: int = 2) -> int:
        """Delete all manifests but the last `keep` and the data folders that no kept one names; the number of folders deleted.
        Run it while no writer is between its data and its commit."""
        return self.log.keep_last(keep, lambda m: {f.split("/_bucket=")[0] for own in m["folders"].values() for f in own.values()})
