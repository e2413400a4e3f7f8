"""Spark sessions for the engine, and sending the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, app: str = "pagemill", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys have underscores for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()


#: Bytes of an Arrow batch that goes to a Python worker: long texts must not come by the ten thousand.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context; their Python finds it wherever it starts.

    Batches for Python workers are held to BATCH_BYTES, unless the session asks for smaller ones.
    """
    sc = spark.sparkContext
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    if size is None or not size.isdigit() or int(size) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if getattr(sc, "_pagemill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    at = os.path.join(tempfile.mkdtemp(prefix="pagemill-"), "pagemill_package.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(at)
    sc._pagemill_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is made only in local mode and where the session names none."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='pagemill-')}")
        path = sc.getCheckpointDir()
    return path.rstrip("/")


#: With it, a query's shuffle files go as soon as the query has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Characters of a plan's description, which the driver keeps for a thousand queries: tables in literals take megabytes each.
_TEXT, PLAN_TEXT = "spark.sql.maxPlanStringLength", 1 << 15
#: Fields of a node in such a description and in the events of a query, which that length does not hold: with none, literals there are not spelled out.
_FIELDS = "spark.sql.debug.maxToStringFields"
#: With it, adaptive execution joins small partitions up to its advisory size, and doesn't cut a small table for every core.
_SMALL = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
#: Without its native library Hadoop starts ``chmod`` for each local folder and file (42 times for a table of 12 files, 29 without checksum files), and until that process is under way it shares all of the executor's memory.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def staged(df: DataFrame, name: str, codec: str = "snappy", few: bool = False, **options: str | int) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    The shuffle files of the write are deleted with its end.  On local disks there
    are no checksum files; ``few``: nor more files than the advisory size asks for.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {key: spark.conf.get(key, None) for key in (_CLEAN, _TEXT, _FIELDS, _SMALL)}
    spark.conf.set(_CLEAN, "true")
    spark.conf.set(_TEXT, str(PLAN_TEXT))
    spark.conf.set(_FIELDS, "0")
    if few:
        spark.conf.set(_SMALL, "false")
    try:
        df.write.option("compression", codec).options(**_PLAIN, **options).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    out = spark.read.schema(df.schema).parquet(path)
    out._pagemill_path = path
    return out


def unstaged(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_pagemill_path", None)
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
