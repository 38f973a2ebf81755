"""Pairs of tiles that large groups of rows are cut into, and forests over the pairs found in them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirplake.llm.util import join_checked


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index in the component of each of n nodes, by repeated hooking and halving."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        left = root[a] != root[b]
        a, b = a[left], b[left]
    return root


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the same components among n nodes: each node that has one and the smallest of its component."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = roots(len(nodes), back[: len(a)], back[len(a) :])
    up = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[up], nodes[root[up]]


def dealt_to_tile_pairs(rows: DataFrame, tiles: DataFrame) -> DataFrame:
    """Add ``pair``, struct(low, high, second): each row once for every pair of tiles that its tile takes part in.

    ``rows`` have bucket and node; ``tiles`` holds (bucket, m) for the buckets of
    more than one tile. A row's tile within its bucket follows from a hash of its
    node, so that a hot bucket is dealt evenly over its tile pairs.
    """
    rows = join_checked(rows, tiles, ["bucket"], "left")
    m = F.coalesce(F.col("m"), F.lit(1)).cast("bigint")
    own = F.pmod(F.xxhash64("node"), m)
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), m - 1), lambda u: F.struct(F.least(own, u).alias("low"), F.greatest(own, u).alias("high"), (own > u).alias("second")))
    return rows.withColumn("pair", F.explode(pairs)).drop("m")
