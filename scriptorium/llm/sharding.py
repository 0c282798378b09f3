"""Size-tiered compaction of immutable Parquet shards under a versioned manifest.

A store is a folder.  ``append`` writes an arrival as small shards (files); they
are never changed.  Shards fall into tiers by size: tier t holds sizes in
[``small`` * ``fanout``**t, ``small`` * ``fanout``**(t+1)).  ``compact`` merges the
shards of every tier that holds ``fanout`` shards or more into files near the
target size: Spark's scan packs small files into read partitions of the target
size and each partition is written as one file, so nothing is shuffled.

A version is a Parquet table of its live shards, named with the rows' schema by a
version file.  That file is created only if it is absent, complete at its close: of two
writers one gets the version, the other must try again on the new one.  A version file
without content is no version yet; one that is older than ``COMMIT_SECONDS`` is of a writer
that was lost, and the next commit takes the number behind it.  The schema is that of all arrivals, merged by
name: rows written without a column read as null in it, and a column cannot change its type.  Readers see only shards of a committed version;
files of an attempt that was lost are never listed, and ``vacuum`` removes them once they
are older than a grace time, in which a writer must have committed.

Defined results: rows are kept as they are (nulls, repeated rows, any columns); an
empty arrival, and a table without rows, commit a version with the same shards, which
reads with its columns; a store without versions cannot be read.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from scriptorium.operators.tables import fresh

TARGET_BYTES = 128 << 20
SMALL_BYTES = 64 << 10
FANOUT = 4
GRACE_SECONDS = 24 * 3600.0
#: A writer that has created a version file closes it within this time, or is taken for lost.
COMMIT_SECONDS = 600.0
_SHARD = "path string, bytes long, n_rows long, tier int"


class VersionConflict(RuntimeError):
    """Another writer committed the version first."""


class SchemaConflict(ValueError):
    """An arrival has a column of the store with another type."""


def merged_schema(old: StructType, new: StructType) -> StructType:
    """The columns of both by name, old ones first, all of them nullable."""
    kinds = {f.name: f.dataType.simpleString() for f in old}
    for f in new:
        if kinds.setdefault(f.name, f.dataType.simpleString()) != f.dataType.simpleString():
            raise SchemaConflict(f"column {f.name} is {kinds[f.name]}, not {f.dataType.simpleString()}")
    names = set(old.names)
    return StructType([StructField(f.name, f.dataType) for f in (*old, *(f for f in new if f.name not in names))])


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, small_bytes: int = SMALL_BYTES, fanout: int = FANOUT, commit_seconds: float = COMMIT_SECONDS):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.small, self.fanout = target_bytes, small_bytes, fanout
        self.commit_seconds = commit_seconds
        self._written: dict[str, StructType] = {}  # schemas of the folders written here

    # -- the shared file system -------------------------------------------------
    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    # -- versions ---------------------------------------------------------------
    def version(self) -> int:
        """The newest committed version; 0 if there is none."""
        fs, folder = self._fs(), self._path("versions")
        if not fs.exists(folder):
            return 0
        names = (f.getPath().getName() for f in fs.listStatus(folder) if f.getLen())
        return max((int(n[1:]) for n in names if n.startswith("v")), default=0)

    def _version_file(self, version: int) -> dict:
        source = self._fs().open(self._path(f"versions/v{version:012d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        """path, bytes, n_rows, tier of the live shards of a version."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _SHARD)
        return self.spark.read.schema(_SHARD).parquet(f"{self.root}/manifests/{self._version_file(version)['manifest']}")

    def schema(self, version: int) -> StructType:
        return StructType.fromJson(self._version_file(version)["schema"])

    def _commit(self, base: int, shards: DataFrame, schema: StructType) -> int:
        name = f"m-{uuid.uuid4().hex}"
        shards.select("path", "bytes", "n_rows", "tier").write.parquet(f"{self.root}/manifests/{name}")
        while self._lost(base + 1):
            base += 1
        try:
            out = self._fs().create(self._path(f"versions/v{base + 1:012d}"), False)
        except Py4JJavaError as e:
            if "Exist" in e.java_exception.getClass().getName() or "exists" in str(e.java_exception.getMessage()):
                raise VersionConflict(f"version {base + 1} exists") from e
            raise
        try:
            self.spark._jvm.org.apache.commons.io.IOUtils.write(json.dumps({"manifest": name, "schema": schema.jsonValue()}), out, "UTF-8")
        finally:
            out.close()
        return base + 1

    def _lost(self, version: int) -> bool:
        """Whether the version's file is an empty one that its writer will not close any more."""
        fs, path = self._fs(), self._path(f"versions/v{version:012d}")
        if not fs.exists(path):
            return False
        status = fs.getFileStatus(path)
        return not status.getLen() and status.getModificationTime() <= (time.time() - self.commit_seconds) * 1000

    def _described(self, folder: str) -> DataFrame:
        """The files of a folder just written, by their footers' row counts."""
        status = self._fs().listStatus(self._path(folder))
        if not any(f.getPath().getName().endswith(".parquet") for f in status):
            return self.spark.createDataFrame([], _SHARD)
        files = self.spark.read.parquet(f"{self.root}/{folder}")
        files = files.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("n_rows"))
        tier = F.greatest(F.lit(0), F.floor(F.log(float(self.fanout), F.col("bytes") / self.small))).cast("int")
        return files.withColumn("tier", tier)

    # -- writers ----------------------------------------------------------------
    def write_arrivals(self, df: DataFrame, arrivals: int) -> list[str]:
        """Write ``df`` as ``arrivals`` folders of small shards, in one pass over it; returns the folders, one at least."""
        name, column = f"data/in-{uuid.uuid4().hex}", fresh(df, "_arrival")
        key = F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns]), F.lit(arrivals))
        df.withColumn(column, key).write.partitionBy(column).parquet(f"{self.root}/{name}")
        self._written[name] = df.schema
        listed = self._fs().listStatus(self._path(name))
        return [f"{name}/{n}" for n in sorted(f.getPath().getName() for f in listed) if n.startswith(f"{column}=")] or [name]

    def append(self, folder: str) -> int:
        """Commit the shards of a written folder as a new version."""
        base = self.version()
        schema = next((s for name, s in self._written.items() if folder.startswith(name)), None)
        if schema is None:
            schema = self.spark.read.parquet(f"{self.root}/{folder}").schema
        schema = merged_schema(self.schema(base) if base else StructType(), schema)
        return self._commit(base, self.manifest(base).unionByName(self._described(folder)), schema)

    def compact(self) -> int:
        """Merge the shards of each tier that is due; returns the current version."""
        base = self.version()
        live = self.manifest(base)
        small = live.filter(F.col("bytes") < self.target // 2)
        due = small.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= self.fanout)
        tiers = sorted(r["tier"] for r in due.collect())  # one row a tier: a logarithm of the sizes
        if not tiers:
            return base
        schema, folders = self.schema(base), []
        keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
        before = {k: self.spark.conf.get(k, None) for k in keys}
        try:
            for k, v in zip(keys, (self.target, 0, 1), strict=True):
                self.spark.conf.set(k, str(v))
            for tier in tiers:  # shards of a similar size go together
                folders.append(f"data/merged-{uuid.uuid4().hex}")
                paths = [r["path"] for r in small.filter(F.col("tier") == tier).select("path").toLocalIterator()]
                self.spark.read.schema(schema).parquet(*paths).write.parquet(f"{self.root}/{folders[-1]}")
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v) if v is not None else self.spark.conf.unset(k)
        kept = live.join(small.filter(F.col("tier").isin(tiers)).select("path"), "path", "left_anti")
        return self._commit(base, reduce(DataFrame.unionByName, map(self._described, folders), kept), schema)

    def vacuum(self, grace_seconds: float = GRACE_SECONDS) -> int:
        """Delete data files older than the grace time that the current version doesn't list; returns how many."""
        fs, gone, limit = self._fs(), 0, (time.time() - grace_seconds) * 1000
        live = {r["path"].rpartition("/")[2] for r in self.manifest().select("path").toLocalIterator()}
        files = fs.listFiles(self._path("data"), True)
        while files.hasNext():
            status = files.next()
            path = status.getPath()
            if path.getName().endswith(".parquet") and path.getName() not in live and status.getModificationTime() <= limit:
                gone += bool(fs.delete(path, False))
        return gone

    # -- readers ----------------------------------------------------------------
    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            raise ValueError("the store has no version")
        schema, paths = self.schema(version), [r["path"] for r in self.manifest(version).select("path").toLocalIterator()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
