"""Session construction, table loading and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder (single-machine tests).
FALLBACK_SHARED = "file:///tmp/checkpoints/scriptorium"


def build_session(app: str = "scriptorium", cpus: int | str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, once a session: tasks import it by name."""
    sc = spark.sparkContext
    if getattr(sc, "_scriptorium_shipped", False):
        return
    home = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="scriptorium-"), "scriptorium.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(archive)
    # Python that Spark starts beside the driver (planning of data sources, streams' processors) does not see added files
    sc.environment["PYTHONPATH"] = os.pathsep.join(p for p in (str(home.parent), sc.environment.get("PYTHONPATH")) if p)
    sc._scriptorium_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``; only a local master does without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or FALLBACK_SHARED).rstrip("/")


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Ends the lineage, so that a lost executor re-reads a file instead of
    recomputing the plan, and no expensive branch is evaluated twice.
    """
    spark = df.sparkSession
    ship_code(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path
    return back


def drop_cut(df: DataFrame) -> None:
    """Delete a table written by :func:`cut` that nothing reads any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the plan, used to choose partition counts."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch: document rows can be very long."""
    ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
