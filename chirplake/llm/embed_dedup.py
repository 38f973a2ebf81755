"""Near-duplicate vectors: spherical k-means cells and blocked cosine products within them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirplake.llm.components import connected_components
from chirplake.llm.tiles import dealt_to_tile_pairs, roots
from chirplake.llm.util import bounded_batches, saved, shuffle_partitions

#: Vectors that the cells are fitted on, at most (those of the smallest hashes of vec_id).
SAMPLE = 20_000
#: Aim of vectors per cell, and most cells.
CELL_ROWS, MAX_CELLS = 256, 4096
#: A vector joins each cell whose centre is nearly as close as the closest: within this much cosine.
MARGIN = 0.12
#: Rows of one tile of a large cell, at least and at most.
TILE_ROWS = (256, 8192)
BLOCK = 1024
_CELLS_OF_LENGTH = 1 << 20
#: A cell of more rows is divided into parts by cells of its own, fitted on about so many of its rows.
SPLIT_ROWS, PART_SAMPLE = 16 * CELL_ROWS, 2048
#: Most parts of a cell, and numbers that are set aside for them.
MAX_PARTS, _PARTS = 256, 1 << 10
#: Rows that take one copy of a cell's part centres.
SHARE_ROWS = 65_536


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centres of k cells of the unit rows of x; a cell that empties keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), size=min(k, len(x)), replace=False))]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        cells, begin = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(x[order], begin, axis=0)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = centres.copy()
        centres[cells] = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres[cells])
    return centres


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (array<double>) of the vectors that can link: no null, nothing infinite, not zero."""
    rows = vectors.groupBy(F.col("vec_id").cast("bigint").alias("vec_id")).agg(F.min("embedding").alias("embedding"))
    rows = rows.where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(finite & F.exists("vec", lambda x: x != 0))


def fit_centres(vectors: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Centres for each vector length found in a bounded sample; lengths not in it have one cell."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    sizes = sample["vec"].map(len)
    out = {}
    for size in sorted(sizes.unique().tolist()):
        x = _unit(np.stack(sample.loc[sizes == size, "vec"].to_list()).astype(np.float64))
        cells = min(MAX_CELLS, max(1, int(count * (len(x) / len(sample)) // CELL_ROWS)))
        out[size] = spherical_kmeans(x, min(cells, max(1, len(x) // 2)))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def assigned(vectors: DataFrame, centres: dict[int, np.ndarray], margin: float = MARGIN) -> DataFrame:
    """node (vec_id), cells array<bigint> (sorted), vec binary: the unit vector as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column(1).offsets.to_numpy()
            sizes = np.diff(offsets)
            values = batch.column(1).values.to_numpy(zero_copy_only=False)
            cells: list[list[int]] = [[]] * batch.num_rows
            data: list[bytes] = [b""] * batch.num_rows
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                x = _unit(values[offsets[rows][:, None] + np.arange(size)[None, :]])
                base = size * _CELLS_OF_LENGTH
                near = x @ centres[size].T if size in centres else np.zeros((len(x), 1))
                close = near >= near.max(1, keepdims=True) - margin
                for i, row in enumerate(rows.tolist()):
                    cells[row] = (np.flatnonzero(close[i]) + base).tolist()
                    data[row] = x[i].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.list_(pa.int64())), pa.array(data, pa.binary())], ["node", "cells", "vec"])

    return bounded_batches(vectors).mapInArrow(run, "node bigint, cells array<bigint>, vec binary")


def divided(rows: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Rows of :func:`assigned` with the parts of large cells in place of the cells.

    A cell of more than ``SPLIT_ROWS`` rows gets spherical k-means cells of its own,
    from a sample of its rows; a row joins all parts within ``margin`` of its best
    one. So the work for a vector does not grow with the number of vectors while
    cells can be divided, up to a million parts in all. A cell whose parts would
    have most rows in common, as one of near copies, stays whole and is tiled.
    """
    spread = rows.select("node", "vec", F.explode("cells").alias("bucket"))
    large = saved(spread.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT_ROWS), "large")
    whole = rows.withColumn("cells", F.transform("cells", lambda c: c * _PARTS))
    if large.isEmpty():
        return whole

    def fit(part: pa.Table) -> pa.Table:
        x = np.stack([np.frombuffer(v, np.float64) for v in part["vec"].to_pylist()])
        k = min(MAX_PARTS, part["n"][0].as_py() // CELL_ROWS, len(x) // 8)
        centres = spherical_kmeans(x, k) if k > 1 else x[:0]
        if k > 1:
            near = x @ centres.T
            share = (near >= near.max(1, keepdims=True) - margin).mean(0)
            if (share**2).sum() > 0.5:  # hardly fewer pairs than in the whole cell
                centres = centres[:0]
        return pa.table({"bucket": part["bucket"][:1], "centres": pa.array([centres.tobytes()], pa.binary())})

    # Cells are some thousands, so their table is small.
    cells = F.broadcast(large.withColumn("m", F.ceil(F.col("n") / SHARE_ROWS).cast("bigint")))
    sampled = spread.join(cells, "bucket").where(F.pmod(F.xxhash64("node", F.lit("part")), F.ceil(F.col("n") / PART_SAMPLE)) == 0)
    parts = saved(sampled.select("bucket", "n", "vec").groupBy("bucket").applyInArrow(fit, "bucket bigint, centres binary").where(F.octet_length("centres") > 0), "parts")
    if parts.isEmpty():
        return whole
    cut = parts.join(cells, "bucket").select("bucket", "m", "centres")
    names = F.broadcast(cut.select("bucket", "m"))
    heads = cut.withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1))).select("bucket", "share", F.lit(None).cast("bigint").alias("node"), F.col("centres").alias("data"), F.lit(0).alias("kind"))
    body = spread.join(names, "bucket").select("bucket", F.pmod(F.xxhash64("node"), F.col("m")).alias("share"), "node", F.col("vec").alias("data"), F.lit(1).alias("kind"))
    dealt = heads.unionByName(body).withColumn("task", F.xxhash64("bucket", "share")).repartition(shuffle_partitions(rows), "task").sortWithinPartitions("task", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = np.empty((0, 0))
        for batch in batches:
            kind, bucket, data = batch["kind"].to_numpy(), batch["bucket"].to_numpy(), batch["data"].to_pylist()
            cuts = np.flatnonzero(kind == 0).tolist()
            for s, e in zip([0, *cuts], [*cuts, len(kind)], strict=True):
                if s < len(kind) and kind[s] == 0:  # a cell's centres come before its rows
                    size = int(bucket[s]) // _CELLS_OF_LENGTH
                    centres, s = np.frombuffer(data[s], np.float64).reshape(-1, size), s + 1  # noqa: PLW2901
                if s < e:
                    near = np.stack([np.frombuffer(v, np.float64) for v in data[s:e]]) @ centres.T
                    close = near >= near.max(1, keepdims=True) - margin
                    base = int(bucket[s]) * _PARTS + 1
                    yield pa.RecordBatch.from_arrays([batch["node"].slice(s, e - s), pa.array([(np.flatnonzero(c) + base).tolist() for c in close], pa.list_(pa.int64()))], ["node", "parts"])

    fine = bounded_batches(dealt.select("bucket", "node", "data", "kind")).mapInArrow(run, "node bigint, parts array<bigint>")
    rest = spread.join(names, "bucket", "left_anti").select("node", F.array(F.col("bucket") * _PARTS).alias("parts"))
    every = fine.unionByName(rest).groupBy("node").agg(F.sort_array(F.flatten(F.collect_list("parts"))).alias("cells"))
    return saved(rows.select("node", "vec").join(every, "node").select("node", "cells", "vec"), "divided")


def _own_pairs(i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray, cell: int) -> np.ndarray:
    """Which pairs have this cell as the smallest that both vectors are in: each pair counts in one cell."""
    keep = np.ones(len(i), bool)
    for at in range(0, len(i), 65_536):
        part = slice(at, at + 65_536)
        left, right = a[i[part]], b[j[part]]
        for c in range(right.shape[1]):
            other = right[:, c : c + 1]
            keep[part] &= ~((left == other) & (other < cell)).any(1)
    return keep


def _padded(cells: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(cells), max(map(len, cells))), fill, np.int64)
    for k, own in enumerate(cells):
        out[k, : len(own)] = own
    return out


def link_tile(ids: np.ndarray, x: np.ndarray, cells: list[np.ndarray], cell: int, second: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of one pair of tiles (of one tile with itself, if none is second): for each row that has one its id, their number, and the smallest row it hangs together with."""
    alone = not second.any()
    left = np.arange(len(ids)) if alone else np.flatnonzero(~second)
    right = left if alone else np.flatnonzero(second)
    a, b = _padded(cells, -1), _padded(cells, -2)
    links = np.zeros(len(ids), np.int64)
    root = np.arange(len(ids))
    for s in range(0, len(left), BLOCK):
        rows = left[s : s + BLOCK]
        for t in range(s if alone else 0, len(right), BLOCK):
            columns = right[t : t + BLOCK]
            i, j = np.nonzero(x[rows] @ x[columns].T >= threshold)
            i, j = rows[i], columns[j]
            pick = i < j if alone else i != j
            i, j = i[pick], j[pick]
            if len(i):
                own = _own_pairs(i, j, a, b, cell)
                i, j = i[own], j[own]
                links += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
                forest = np.flatnonzero(root != np.arange(len(ids)))
                root = roots(len(ids), np.r_[i, forest], np.r_[j, root[forest]])
    found = np.flatnonzero(links)
    return ids[found], links[found], ids[root[found]]


def find_links(rows: DataFrame, threshold: float, tile_rows: int | None = None) -> DataFrame:
    """vec_id, links, root: what each pair of tiles found for each of its vectors, from the rows of :func:`assigned`."""
    spread = rows.select("node", "cells", "vec", F.explode("cells").alias("bucket"))
    counts = spread.groupBy("bucket").agg(F.count("*").alias("n"))
    if tile_rows is None:
        total = counts.agg(F.sum("n")).first()[0] or 0
        tile_rows = min(TILE_ROWS[1], max(TILE_ROWS[0], total // (2 * shuffle_partitions(rows))))
    # Cells are as many as centres, a few thousand at most for each vector length.
    tiles = counts.select("bucket", F.ceil(F.col("n") / tile_rows).cast("bigint").alias("m")).where("m > 1")
    routed = dealt_to_tile_pairs(spread, saved(tiles, "tiles"))
    routed = routed.select(F.xxhash64("bucket", "pair.low", "pair.high").alias("task"), "node", F.col("pair.second").cast("int").alias("second"), "bucket", "cells", "vec")
    placed = routed.repartition(shuffle_partitions(rows), "task").sortWithinPartitions("task")

    def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(held).combine_chunks()
        x = np.stack([np.frombuffer(v, np.float64) for v in part["vec"].to_pylist()])
        cells = [np.array(c) for c in part["cells"].to_pylist()]
        got = link_tile(part["node"].to_numpy(), x, cells, part["bucket"][0].as_py(), part["second"].to_numpy().astype(bool), threshold)
        return pa.RecordBatch.from_arrays([pa.array(g) for g in got], ["vec_id", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            task = batch.column(0).to_numpy()
            cuts = np.r_[0, np.flatnonzero(task[1:] != task[:-1]) + 1, len(task)] if len(task) else [0]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if held and task[s] != last:
                    yield emit(held)
                    held = []
                held.append(batch.slice(s, e - s))
                last = task[s]
        if held:
            yield emit(held)

    return bounded_batches(placed).mapInArrow(run, "vec_id bigint, links bigint, root bigint")


def similar_vectors(vectors: DataFrame, threshold: float = 0.95, margin: float = MARGIN) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vec_id of ``vectors`` (vec_id, embedding).

    Cells come from spherical k-means on a bounded sample; every vector is
    assigned to its closest centre and to all within ``margin`` of it, large cells
    are divided in the same way (:func:`divided`), and all vectors of a cell are
    compared, in tiles if it is still large. So a pair is found if the two share a
    cell; the measured recall is in the tests. A pair that shares several counts in
    the smallest. Tasks return counts and forests,
    not pairs.

    Vectors that are null, zero or hold a null or an infinite or undefined number
    link with nothing; nor do vectors of different lengths, nor a null vec_id.
    Rows that repeat a vec_id are one vector, that of the smallest embedding. An
    empty table gives an empty table; other columns are ignored.
    """
    good = saved(usable(vectors), "vectors")
    count = good.count()
    found = saved(find_links(divided(saved(assigned(good, fit_centres(good, count), margin), "assigned"), margin), threshold), "links")
    labels = connected_components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")).where("a <> b"))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links")).withColumnRenamed("vec_id", "node")
    every = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id")).distinct().withColumn("node", F.col("vec_id"))
    out = every.join(links, "node", "left").join(labels, "node", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


#: All pairs, for tables of some thousand vectors.
VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reach AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
lowest AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, root AS component_id, v.vec_id = root AS kept
FROM v JOIN lowest ON lowest.id = v.vec_id LEFT JOIN counted ON counted.a = v.vec_id
"""
