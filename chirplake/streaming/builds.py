"""Sample tables built event by event as their numbers arrive, readable at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirplake.config import DatasetConfig
from chirplake.operators import audits, synthesis
from chirplake.operators.scratch import saved
from chirplake.operators.segments import Segments


def read_numbers(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Files of event numbers (num) as they arrive in a folder."""
    return spark.readStream.schema("num bigint").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def built(spark: SparkSession, out: str) -> DataFrame:
    """The samples of all batches that passed their audit; a batch that is being written, or failed, is not among them."""
    done = spark.read.option("basePath", f"{out}/audits").parquet(f"{out}/audits/batch=*").select("batch").distinct()
    rows = spark.read.option("basePath", f"{out}/samples").parquet(f"{out}/samples/batch=*")
    return rows.join(F.broadcast(done), "batch", "left_semi")  # a row a batch


def run_builds(numbers: DataFrame, config: DatasetConfig, out: str, checkpoint: str, segments: Segments | None = None, energy: bool = True) -> None:
    """Build the samples of the events that are new in the stream ``numbers`` (num), then stop.

    Splits are drawn over all ``config.num_events`` events by the first batch and
    kept beside the samples, so that the result is that of one build, whatever the batches are.
    A number that comes again, in one batch or in two, is built once; null numbers
    and those from ``num_events`` on belong to no split and are left out. Each batch writes its
    own folder, is audited together with all before it (which reads the key columns of all
    samples so far), and counts from then on (:func:`built`). A run that is cut off goes on with the batch that it was at, which
    writes over its own folders; a failed audit is an error and leaves the batch out.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        if number == 0:
            synthesis.event_splits(spark.range(config.num_events).withColumnRenamed("id", "num"), config).write.mode("overwrite").parquet(f"{out}/splits")
        fresh = rows.select("num").distinct().join(spark.read.parquet(f"{out}/splits"), "num")
        if number > 0:
            before = built(spark, out).where(F.col("batch") < number).select(F.col("event_id")).distinct()
            fresh = fresh.withColumn("event_id", synthesis.event_name(F.col("num"))).join(before, "event_id", "left_anti").drop("event_id")
        made = synthesis.build_samples(fresh, config, segments, energy).drop("boxes")
        made.write.mode("overwrite").partitionBy("split").parquet(f"{out}/samples/batch={number}")
        now = spark.read.option("basePath", f"{out}/samples").parquet(f"{out}/samples/batch={number}")
        all_rows = now if number == 0 else built(spark, out).where(F.col("batch") < number).unionByName(now)
        report = saved(audits.rollup(all_rows), "audit")
        audits.require(report)
        report.write.mode("overwrite").parquet(f"{out}/audits/batch={number}")

    numbers.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
