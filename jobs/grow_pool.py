"""Grow a pool of transients from the catalog files that have arrived since the last run.

    python -m jobs.grow_pool --events PATH --output PATH --checkpoint PATH [--config FILE]

A file stream with a checkpoint takes each file once. Each batch is cleaned, freed of
events that the pool already has, and allocated to train, val and test by source group.
A group that has its split keeps it for ever, whatever comes later, so that data sets
made from earlier states of the pool and from later ones do not leak into each other; new
groups go where rows are lacking by then. ``pool`` is partitioned by batch, split and detector,
``groups`` (rows and split of each group that a batch touched) by batch. A batch that is run
again after a failure sees only the batches before it and writes over its own folders.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirplake.operators import audits, groups
from chirplake.operators.scratch import saved
from chirplake.sources import views
from chirplake.streaming.groups import read_events

log = logging.getLogger("jobs.grow_pool")
CONFIG = Path(__file__).with_name("grow_pool.json")
POOL = "ord bigint, gps double, label string, snr double, grp string, batch bigint, split string, ifo string"
GROUPS = "grp string, n bigint, split string, ifo string, batch bigint"


def cleaned(events: DataFrame, settings: dict) -> DataFrame:
    """Events as rows of the pool: with a time, loud enough, of the labels that are asked for (none: all), each detector and time once, as its smallest ord."""
    rows = groups.confident(views.as_pool(events), F.col("snr"), settings["min_snr"], labels=tuple(settings["labels"]))
    once = rows.groupBy("ifo", "gps").agg(F.min(F.struct("ord", "label", "snr", "grp")).alias("e"))
    return once.select("e.ord", "gps", "e.label", "e.snr", "e.grp", "ifo")


def unseen(rows: DataFrame, pool: DataFrame) -> DataFrame:
    """Rows that the pool does not have at their detector and time; only the times that the rows span are read of it."""
    span = rows.agg(F.min("gps").alias("a"), F.max("gps").alias("b")).first()
    return rows.join(pool.where(F.col("gps").between(span["a"], span["b"])).select("ifo", "gps"), ["ifo", "gps"], "left_anti")


def allocated(counts: DataFrame, before: DataFrame, settings: dict) -> DataFrame:
    """Split of each group in ``counts`` (ifo, grp, n): as in ``before`` (ifo, grp, n, split, one row a batch that touched the group), else where rows lack."""
    known = before.groupBy("ifo", "grp").agg(F.min("split").alias("split"))
    old = saved(counts.join(known, ["ifo", "grp"]), "old")
    new = counts.join(known, ["ifo", "grp"], "left_anti")
    have = before.select("ifo", "split", "n").unionByName(old.select("ifo", "split", "n")).groupBy("ifo", "split").agg(F.sum("n").alias("n"))
    return old.select("ifo", "grp", "n", "split").unionByName(groups.assign_many(new, settings["ratios"], have, settings["heavy"]))


def grow_pool(spark: SparkSession, events: str, output: str, checkpoint: str, settings: dict) -> DataFrame:
    """Take what is new, then stop; the whole pool as it then stands.

    Null times, detectors' numbers and the like follow the pool's readers: a row without a
    time is left out, one without a source group cannot be. Files that bring nothing new change
    nothing. The input may be empty of rows, but must have a schema.
    """
    # Tables without rows, so that every batch finds something to read.
    for name, schema, inner in (("pool", POOL, ("split", "ifo")), ("groups", GROUPS, ())):
        fields = ", ".join(f for f in schema.split(", ") if not f.startswith("batch "))
        spark.createDataFrame([], fields).write.mode("ignore").partitionBy(*inner).parquet(f"{output}/{name}/batch=-1")

    def state(name: str, schema: str, number: int | None = None) -> DataFrame:
        rows = spark.read.schema(schema).option("basePath", f"{output}/{name}").parquet(f"{output}/{name}")
        return rows if number is None else rows.where(F.col("batch") < number)

    def batch(rows: DataFrame, number: int) -> None:
        arrived = rows.count()
        fresh = saved(unseen(saved(cleaned(rows, settings), "cleaned"), state("pool", POOL, number)), "fresh")
        split = allocated(groups.group_counts(fresh), state("groups", GROUPS, number), settings)
        split.select("grp", "n", "split", "ifo").write.mode("overwrite").parquet(f"{output}/groups/batch={number}")
        split = state("groups", GROUPS).where(F.col("batch") == number).select("ifo", "grp", "split")
        made = fresh.join(split, ["ifo", "grp"]).select("ord", "gps", "label", "snr", "grp", "split", "ifo")
        made.write.mode("overwrite").partitionBy("split", "ifo").parquet(f"{output}/pool/batch={number}")
        log.info("batch %d: read %d events, wrote %d new ones to %s/pool", number, arrived, fresh.count(), output)

    stream = read_events(spark, events, settings["files_per_batch"]).writeStream.foreachBatch(batch)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    pool = state("pool", POOL)
    if not (found := audits.leaks(pool, F.concat_ws("|", "ifo", "grp"))).isEmpty():
        raise audits.AuditError(f"source groups in several splits: {audits.offenders(found)}")
    log.info("the pool in %s has %d events in %d batches", output, pool.count(), pool.select("batch").distinct().count())
    return pool


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("events", "output", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=str(CONFIG))
    given = p.parse_args(args)
    logging.basicConfig(level=logging.INFO)
    settings = json.loads(Path(given.config).read_text())
    spark = SparkSession.builder.appName("grow_pool").getOrCreate()
    try:
        grow_pool(spark, given.events, given.output, given.checkpoint, settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
