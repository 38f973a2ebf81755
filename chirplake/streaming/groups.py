"""Streaming counts per source group, and a resumable fetch loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirplake.config import FILE_SECONDS

WINDOW = f"{FILE_SECONDS} seconds"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Files of events as they arrive, with a zoned timestamp, as watermarks need one."""
    schema = spark.read.parquet(path).schema
    # As a pattern, so that a table may be one file; a plain path must be a folder.
    path = f"{path[:-1]}[{path[-1]}]"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def group_counts(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Rows per detector and 4096 s window: the source groups, as tumbling windows. Later rows than the watermark do not count."""
    ifo = F.when(F.col("user_id") % 2 == 0, "H1").otherwise("L1")
    marked = events.withWatermark("ts", lateness)
    out = marked.groupBy(F.window("ts", WINDOW).alias("w"), ifo.alias("ifo")).agg(F.count("*").alias("n"))
    return out.select("ifo", (F.unix_timestamp("w.start") / FILE_SECONDS).cast("bigint").alias("fid"), "n")


def run_counts(spark: SparkSession, path: str, checkpoint: str, sink: str) -> DataFrame:
    """Work through what there is, then stop: each batch writes the counts that it changed into ``sink``, and the last count of each window is the result.

    A batch that is run again writes over its own folder.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    q = group_counts(read_events(spark, path)).writeStream.outputMode("update").foreachBatch(batch)
    q.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", sink).parquet(f"{sink}/batch=*").groupBy("ifo", "fid").agg(F.max_by("n", "batch").alias("n"))


def resumable(source: DataFrame, checkpoint: str, done: Callable[[SparkSession], DataFrame], keys: list[str], work: Callable[[DataFrame], DataFrame], sink: str) -> None:
    """Fetch-like work on each new row once: rows whose keys are in ``done`` (cache and blacklist) are skipped.

    A batch that is run again after a failure finds its own results in ``done``,
    so it appends nothing twice.
    """

    def batch(rows: DataFrame, _: int) -> None:
        fresh = rows.dropDuplicates(keys).join(done(rows.sparkSession).select(*keys).distinct(), keys, "left_anti")
        work(fresh).write.mode("append").parquet(sink)

    source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
