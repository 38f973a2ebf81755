"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a folder of our own only where that is unset and one machine does all the work.

    On a cluster executors would each write to a disk of their own, so there an
    unset folder is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="chirplake-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/chirplake-{sc.applicationId}"


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: Spark's setting by which the shuffle files of a query go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_FOLDER = contextvars.ContextVar("folder", default="")


@contextlib.contextmanager
def kept_for_results() -> Iterator[None]:
    """Tables that :func:`saved` writes in here are read by the frame that is returned, so nobody can delete them on the way; they lie in a folder of their own."""
    token = _FOLDER.set("kept/")
    try:
        yield
    finally:
        _FOLDER.reset(token)


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back.

    This cuts the lineage with a table that every executor can read, so that
    lost executors cost a reread and no recomputation. The shuffle files behind it go
    with the write. The table goes when the
    application ends, or earlier through :func:`forget`.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{_FOLDER.get()}{label}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    where, system = _place(spark, path)
    system.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def once(df: DataFrame, label: str) -> DataFrame:
    """``df`` if :func:`saved` wrote it, else the table that it now writes."""
    return df if hasattr(df, "_scratch") else saved(df, label)


def forget(*tables: DataFrame) -> None:
    """Delete the tables that :func:`saved` wrote for these."""
    for df in tables:
        where, system = _place(df.sparkSession, df._scratch)
        system.delete(where, True)
