"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chirplake.operators.scratch import forget, saved, scratch_root
from chirplake.ship import ship

__all__ = ["bounded_batches", "forget", "grouped", "join_checked", "map_rows", "running", "saved", "scratch_root", "shuffle_partitions", "table", "unused", "utf8"]

#: Largest number of key rows that :func:`join_checked` broadcasts.
BROADCAST_ROWS = 500_000
#: Largest number of bytes that Spark hands to a Python worker at once.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(df: DataFrame) -> DataFrame:
    """Have Spark cut Arrow batches by bytes, so that long texts cannot pile up in a worker; workers get this package."""
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    stated = conf.get(key).lower()
    if not stated.rstrip("b").isdigit() or int(stated.rstrip("b")) > BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")
    return df


def map_rows(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """mapInArrow of bounded batches, whatever the names of the columns (Spark's own takes none with dots)."""
    plain = [f"c{k}" for k in range(len(schema.fields))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, plain)

    kinds = T.StructType([T.StructField(n, f.dataType) for n, f in zip(plain, schema.fields, strict=True)])
    return bounded_batches(rows.toDF(*[f"c{k}" for k in range(len(rows.columns))])).mapInArrow(renamed, kinds).toDF(*schema.names)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_checked(df: DataFrame, keys: DataFrame, on: list[str], how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with ``keys``: by broadcast if a count shows at most ``limit`` narrow rows, else by a shuffle."""
    if keys.count() <= limit:
        keys = F.broadcast(keys)
    return df.join(keys, on, how)


def running(df: DataFrame, order: list[Column], label: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """Add ``place``, the number of rows before each one in the order, and for each column of ``sums`` its sum over these as ``<name>_before``.

    Rows are written once in ranges of the order, which cuts lineage and fixes who lies
    where; equal rows lie in any order. Counts and sums of the ranges, a row each, are
    added up in one place, and those within a range in it.
    """
    ranged = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), label)
    ranged = ranged.withColumn("__part", F.shiftright("__id", 33))
    totals = ranged.groupBy("__part").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{c}") for c in sums])
    until = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = Window.orderBy("__part")
    starts = totals.select("__part", until("__n", ranges).alias("__first"), *[until(f"__{c}", ranges).alias(f"__until_{c}") for c in sums])
    out = ranged.join(F.broadcast(starts), "__part").withColumn("place", F.col("__first") + F.col("__id").bitwiseAND((1 << 33) - 1))
    within = Window.partitionBy("__part").orderBy("__id")
    for c in sums:
        out = out.withColumn(f"{c}_before", F.col(f"__until_{c}") + until(c, within))
    return out.drop("__id", "__part", "__first", *[f"__until_{c}" for c in sums])


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own, lengthened until ``df`` has none of them, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"  # noqa: PLW2901
        taken.add(name.lower())
        out.append(name)
    return out


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, None for null."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def grouped(texts: list[str], chars: int) -> Iterator[list[str]]:
    """The texts in groups of some ``chars`` characters, at least one text each."""
    group: list[str] = []
    size = 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group
