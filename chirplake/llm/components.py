"""Connected components of a graph that is held in tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirplake.llm.tiles import roots
from chirplake.llm.util import forget, saved
from chirplake.ship import ship

#: Edges that one task labels by itself (some 50 MB of memory).
ONE_TASK_EDGES = 1_000_000


def connected_components(edges: DataFrame) -> DataFrame:
    """Label every node of ``edges`` (a bigint, b bigint) with the smallest node of its component.

    Alternates the large-star and small-star steps of Kiveris et al. (2014):
    each round hangs a node's neighbours onto the smallest of them, until each
    component is one star. A node with very many neighbours is combined before its
    rows move in the minima. The joins are between plain tables that are shuffled
    for them alone, so that adaptive execution can split such a node's rows; the
    driver sees only two numbers a round. At most ``ONE_TASK_EDGES`` different
    edges need no rounds: one task labels them.

    Returns node, component, one row per node that has an edge; loops, rows with
    nulls and repeated edges are left out. Empty edges give an empty table.
    """
    star = saved(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    mark = _mark(star)
    if mark[0] <= ONE_TASK_EDGES:
        ship(star.sparkSession)
        return star.repartition(1).mapInArrow(_labelled, "node bigint, component bigint")
    while True:
        both = star.select("u", "v").unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        # Neighbours above a node hang onto the smallest: those are its edges with the node as the lower end.
        large = saved(star.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low_large = saved(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = (
            large.join(low_large, "u")
            .where("v > m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low_large.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = saved(small, "edges")
        for old in (star, low, large, low_large):
            forget(old)
        star, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    stars = star.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches]
    if parts:
        nodes, place = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
        upper, lower = place.reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[roots(len(nodes), upper, lower)])], ["node", "component"])


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and an order-free checksum of them."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)
