"""A vector collection in a shared folder, as a sink and a table.

``format("vectors")`` writes rows (chunk_id, embedding, payload, user_id) as a batch or a stream.  Each task
checks its rows and writes one file, a row group for every ``batch_size`` of them, under a name of its own; what it
returns to the driver is the file's name.  The commit is one small file that names those of all tasks; it is
moved to its place when it is complete.  Files that no commit names, of a killed attempt, say, are invisible;
an abort deletes those it hears of.

A write carries a batch id (a stream's number of the micro-batch, or the option ``batch_id``).  A batch id
that is committed already is not committed again: writing a batch twice leaves it once.  Commits have an order,
and the row of a chunk_id in the last one counts (of several in one commit, the greatest);
``read_vectors`` shows that, ``compact`` keeps only that.

A row is refused if its id or vector is null, its vector has another length than ``dimension``, or a component is
null or not finite.  With ``invalid`` = ``fail`` (the default) that fails the write and nothing of it becomes visible; with
``quarantine`` such rows go to the collection's rejects with the reason.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from scriptorium.session import ship_code

SCHEMA = "chunk_id string, embedding array<float>, payload string, user_id string"
REJECTS = f"{SCHEMA}, reason string"
_ARROW = pa.schema([("chunk_id", pa.string()), ("embedding", pa.list_(pa.float32())), ("payload", pa.string()), ("user_id", pa.string())])


class InvalidVector(ValueError):
    """A row that the collection cannot take."""


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote."""

    files: list[str] = field(default_factory=list)
    rejects: list[str] = field(default_factory=list)
    rows: int = 0


def reasons(batch: pa.RecordBatch, dimension: int) -> list[str | None]:
    """Why each row is refused; null for good ones."""
    vectors = batch.column("embedding")
    sizes = np.asarray(vectors.value_lengths().fill_null(-1))
    flat = vectors.flatten()
    finite = np.isfinite(np.asarray(flat.fill_null(float("nan"))))
    at = np.r_[0, np.cumsum(np.maximum(sizes, 0))]
    good = np.r_[0, np.cumsum(finite)]
    whole = good[at[1:]] - good[at[:-1]] == np.maximum(sizes, 0)
    ids = batch.column("chunk_id").to_pylist()
    return [
        "no id" if i is None else "no embedding" if n < 0 else f"{n} components, not {dimension}" if n != dimension else None if ok else "components that are no numbers"
        for i, n, ok in zip(ids, sizes.tolist(), whole.tolist(), strict=True)
    ]


class _Collection:
    def __init__(self, options: dict[str, str]):
        self.root, self.dimension = options["root"].rstrip("/"), int(options["dimension"])
        self.batch_size = int(options.get("batch_size", 100))
        self.quarantine = options.get("invalid", "fail") == "quarantine"
        self.batch_id = options.get("batch_id") or uuid.uuid4().hex

    def open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = self.open()
        made, name = Written(), uuid.uuid4().hex
        writers: dict[str, pq.ParquetWriter] = {}

        def put(kind: str, table: pa.Table) -> None:
            if kind not in writers:
                system.create_dir(f"{root}/{kind}")
                writers[kind] = pq.ParquetWriter(f"{root}/{kind}/{name}.parquet", table.schema, filesystem=system)
                (made.files if kind == "data" else made.rejects).append(f"{name}.parquet")
            writers[kind].write_table(table, row_group_size=self.batch_size)

        try:
            held: list[pa.Table] = []
            for batch in batches:
                why = reasons(batch, self.dimension)
                bad = pa.array([w is not None for w in why])
                rows = pa.Table.from_batches([batch]).select(_ARROW.names).cast(_ARROW)
                if any(why):
                    if not self.quarantine:
                        k = next(i for i, w in enumerate(why) if w)
                        raise InvalidVector(f"chunk {batch.column('chunk_id')[k].as_py()}: {why[k]}")
                    put("rejects", rows.append_column("reason", pa.array(why, pa.string())).filter(bad))
                    rows = rows.filter(pa.array([w is None for w in why]))
                made.rows += rows.num_rows
                held.append(rows)
                if sum(t.num_rows for t in held) >= self.batch_size:  # whole batches leave, the rest waits
                    all_ = pa.concat_tables(held)
                    whole = all_.num_rows - all_.num_rows % self.batch_size
                    put("data", all_.slice(0, whole))
                    held = [all_.slice(whole)]
            if held and (rest := pa.concat_tables(held)).num_rows:
                put("data", rest)
        finally:
            for w in writers.values():
                w.close()
        return made

    def commits(self, system: fs.FileSystem, root: str) -> dict[str, int]:
        """The number of each committed batch."""
        found = system.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
        names = [f.base_name.removesuffix(".json") for f in found if f.base_name.endswith(".json") and not f.base_name.startswith((".", "_"))]
        return {n.partition("-")[2]: int(n.partition("-")[0]) for n in names}

    def commit(self, messages: list[Written | None], batch_id: str) -> None:
        system, root = self.open()
        done = self.commits(system, root)
        if batch_id in done:  # written before, perhaps by an attempt whose end nobody saw
            self.abort(messages)
            return
        parts = [m for m in messages if m is not None]
        body = {"files": [f for m in parts for f in m.files], "rejects": [f for m in parts for f in m.rejects], "rows": sum(m.rows for m in parts)}
        system.create_dir(f"{root}/commits")
        place = f"{root}/commits/.{uuid.uuid4().hex}"
        with system.open_output_stream(place) as out:
            out.write(json.dumps(body).encode())
        system.move(place, f"{root}/commits/{max(done.values(), default=0) + 1:012d}-{batch_id}.json")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = self.open()
        for m in messages:
            for kind, files in (("data", m.files), ("rejects", m.rejects)) if m is not None else ():
                for f in files:
                    if system.get_file_info(f"{root}/{kind}/{f}").type == fs.FileType.File:
                        system.delete_file(f"{root}/{kind}/{f}")


class VectorWriter(DataSourceArrowWriter):
    def __init__(self, collection: _Collection):
        self.collection = collection

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.collection.write(iterator)

    def commit(self, messages) -> None:
        self.collection.commit(messages, self.collection.batch_id)

    def abort(self, messages) -> None:
        self.collection.abort(messages)


class VectorStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, collection: _Collection):
        self.collection = collection

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.collection.write(iterator)

    def commit(self, messages, batchId: int) -> None:
        self.collection.commit(messages, f"epoch{batchId:012d}")

    def abort(self, messages, batchId: int) -> None:
        self.collection.abort(messages)


class VectorSink(DataSource):
    """``format("vectors")`` with options root, dimension, batch_size, invalid, batch_id."""

    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> VectorWriter:
        return VectorWriter(_Collection(self.options))

    def streamWriter(self, schema, overwrite: bool) -> VectorStreamWriter:
        return VectorStreamWriter(_Collection(self.options))


def as_rows(df: DataFrame) -> DataFrame:
    """The columns of a collection, of their types, from a table that has them; payload and user_id may be absent."""
    has = set(df.columns)
    kinds = [c.split(" ") for c in SCHEMA.split(", ")]
    return df.select(*[(F.col(c) if c in has else F.lit(None)).cast(kind).alias(c) for c, kind in kinds])


def upsert(df: DataFrame, root: str, dimension: int, **options) -> None:
    """Write the rows of ``df`` as one batch."""
    ship_code(df.sparkSession)
    df.sparkSession.dataSource.register(VectorSink)
    as_rows(df).write.format("vectors").mode("append").options(root=root, dimension=str(dimension), **{k: str(v) for k, v in options.items()}).save()


def upsert_stream(df: DataFrame, root: str, dimension: int, checkpoint: str, **options):
    """A stream writer of the rows of ``df``; ``start()`` is up to the caller."""
    ship_code(df.sparkSession)
    df.sparkSession.dataSource.register(VectorSink)
    return as_rows(df).writeStream.format("vectors").outputMode("append").option("checkpointLocation", checkpoint).options(root=root, dimension=str(dimension), **{k: str(v) for k, v in options.items()})


def _committed(spark: SparkSession, root: str, kind: str) -> dict[str, int]:
    """The files that commits name, with the commit's number."""
    system, path = fs.FileSystem.from_uri(root)
    found: dict[str, int] = {}
    for info in system.get_file_info(fs.FileSelector(f"{path}/commits", allow_not_found=True)):
        if info.base_name.endswith(".json") and not info.base_name.startswith((".", "_")):
            with system.open_input_stream(info.path) as f:
                found |= dict.fromkeys(json.loads(f.read())[kind], int(info.base_name.partition("-")[0]))
    return found


def read_vectors(spark: SparkSession, root: str) -> DataFrame:
    """The collection as it stands: for each chunk_id the row of the last commit; of several in one commit the greatest."""
    files = _committed(spark, root, "files")
    if not files:
        return spark.createDataFrame([], SCHEMA)
    numbers = spark.createDataFrame(list(files.items()), "file string, number long")  # one row a task of each commit
    rows = spark.read.schema(SCHEMA).parquet(*[f"{root}/data/{f}" for f in files])
    rows = rows.withColumn("file", F.element_at(F.split("_metadata.file_path", "/"), -1)).join(numbers, "file").drop("file")
    newest = rows.groupBy("chunk_id").agg(F.max_by(F.struct("embedding", "payload", "user_id"), F.struct("number", "payload", "user_id", "embedding")).alias("row"))
    return newest.select("chunk_id", "row.embedding", "row.payload", "row.user_id")


def compact(spark: SparkSession, root: str, dimension: int) -> None:
    """One more commit with what counts, and the ones before it forgotten; no other writer may be at work."""
    before = _committed(spark, root, "files")
    upsert(read_vectors(spark, root), root, dimension, batch_id=f"compact-{uuid.uuid4().hex}")
    system, path = fs.FileSystem.from_uri(root)
    last = max(_committed(spark, root, "files").values(), default=0)
    for info in system.get_file_info(fs.FileSelector(f"{path}/commits", allow_not_found=True)):
        if info.base_name.endswith(".json") and int(info.base_name.partition("-")[0]) < last:
            system.delete_file(info.path)
    for f in before:
        system.delete_file(f"{path}/data/{f}")


def read_rejects(spark: SparkSession, root: str) -> DataFrame:
    files = _committed(spark, root, "rejects")
    return spark.read.schema(REJECTS).parquet(*[f"{root}/rejects/{f}" for f in files]) if files else spark.createDataFrame([], REJECTS)
