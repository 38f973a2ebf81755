"""SimHash fingerprints and near-duplicate groups of them, compared tile by tile."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations, pairwise
from math import ceil, comb, log, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chirplake.llm.components import connected_components
from chirplake.llm.tiles import dealt_to_tile_pairs, forest
from chirplake.llm.util import bounded_batches, join_checked, saved, shuffle_partitions, unused, utf8

#: Rows that a task compares with one another, at least and at most; a bucket with more is cut into several tiles.
TILE_ROWS = (512, 65_536)
#: Rows of the square tiles within a task, and tile pairs that are compared at once.
SIDE, TILE_PAIRS = 64, 256
#: Pairs that a task holds before it reduces them.
HELD_PAIRS = 1 << 20
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = (np.arange(8, dtype=np.int64) * 256)[None, :]
#: Sizes of sets below which the differing bits are counted out.
EXACT_SIZES = 64
#: Multipliers and offset that derive further hash words from the first (SplitMix64, fixed values).
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)
#: Words of 64 bits of the fingerprints that pick candidates by similarity, and the share of the pairs at the threshold that their tables must bring together.
WORDS, RECALL = 8, 0.999


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words; of all words if there are fewer; none without words."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the blanks 0x20 and 0x09-0x0D
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if n <= size:
        return np.array([digest(b" ".join(words), 42)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    pieces = zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(line[a:b], 42) for a, b in pieces), np.uint64, n - size + 1)


def majority(hashes: np.ndarray) -> int:
    """A 64-bit word whose bits are set in over half of the hashes."""
    if not len(hashes):
        return 0
    lanes = hashes.view(np.uint8).reshape(-1, 8).astype(np.int64) + _LANES
    counts = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    bits = (2 * counts > len(hashes)).astype(np.uint8).ravel()
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def majorities(hashes: np.ndarray, words: int) -> np.ndarray:
    """That many majority words, of the hashes themselves and of words mixed from them."""
    counts = np.zeros(64 * words, np.int64)
    offsets = np.arange(1, words, dtype=np.uint64) * np.uint64(_MIX[2])
    for at in range(0, len(hashes), 255):  # so many at most count up within a byte
        part = hashes[at : at + 255, None]
        x = part + offsets
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
        every = np.concatenate([part, x ^ (x >> np.uint64(31))], axis=1)
        counts += np.unpackbits(every.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, shingle_words: int = 3, words: int = 1, distinct: bool = False, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, f0..f{words-1} (64 bits each, as signed bigint) and n_shingles of each row of ``docs``.

    A null text is an empty one; without words the fingerprint is zero. Whole
    texts count, repeated shingles as often as they occur, or once if ``distinct``.
    Then n_shingles is the size of the set, and ``node`` is a hash of the set.
    Rows that repeat are carried as they are; the columns of ``carry`` are bigint.
    """
    names = [f"f{k}" for k in range(words)]
    of = majorities if words > 1 else lambda hashes, _: np.array([majority(hashes)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((words, batch.num_rows), np.uint64)
            sizes, nodes = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64)
            for i, text in enumerate(utf8(batch.column(len(carry)))):
                hashes = shingle_hashes(text or b"", shingle_words)
                if distinct:
                    hashes = np.unique(hashes)
                    nodes[i] = xxhash.xxh64_intdigest(hashes.tobytes(), 42)
                sizes[i] = len(hashes)
                out[:, i] = of(hashes, words)
            columns = [*batch.columns[:-1], *(pa.array(x.view(np.int64)) for x in out), pa.array(sizes), *([pa.array(nodes.view(np.int64))] if distinct else [])]
            yield pa.RecordBatch.from_arrays(columns, columns_out)

    columns_out = [*carry, *names, "n_shingles", *(["node"] if distinct else [])]
    rows = docs.select(*[F.col(c).cast("bigint").alias(c) for c in carry], F.col("text").cast("string").alias("text"))
    return bounded_batches(rows).mapInArrow(run, ", ".join(f"{c} bigint" for c in columns_out))


# ------------------------------------------------------------------ buckets
def _by_word(mask: int, words: int) -> tuple[int, ...]:
    return tuple(mask >> (64 * k) & (2**64 - 1) for k in range(words))


def block_tables(rows: int, radius: int, words: int = 1) -> list[tuple[int, ...]]:
    """Masks (one a word) of which two fingerprints within the radius agree on one at least.

    The bits are cut into more blocks than the radius; a table takes all but as
    many of them as the radius. More blocks make more tables of longer keys, so
    that the buckets stay small as the rows grow; what is found is the same.
    """
    bits = 64 * words

    def cost(blocks: int) -> float:  # a row costs about as much as a thousand comparisons
        return comb(blocks, radius) * (1 + rows / 2.0 ** (bits * (blocks - radius) / blocks) / 1000)

    blocks = min(range(radius + 1, min(radius + 6, bits) + 1), key=cost)
    edges = [round(bits * k / blocks) for k in range(blocks + 1)]
    pieces = [(1 << b) - (1 << a) for a, b in pairwise(edges)]
    return [_by_word(sum(some), words) for some in combinations(pieces, blocks - radius)]


def sampled_tables(rows: int, share: float, words: int = WORDS, recall: float = RECALL) -> list[tuple[int, ...]]:
    """Masks of which fingerprints that differ in ``share`` of their bits agree on one with probability ``recall``, whatever the number of rows.

    Keys get a bit longer each time the rows double, so that a bucket of unlike
    rows keeps some 256 of them, and tables get more to make up for it. Keys are
    blocks of bits while there are enough, then random choices of bits.
    """
    size = max(6, round(log2(max(rows, 1))) - 8)
    count = ceil(log(1 - recall) / log(1 - (1 - share) ** size))
    rng = np.random.default_rng(11)
    out = []
    for t in range(count):
        word, turn = t % words, t // words
        places = range(turn * size, (turn + 1) * size) if (turn + 1) * size <= 64 else rng.choice(64, min(size, 64), replace=False).tolist()
        out.append(_by_word(sum(1 << int(p) for p in places) << (64 * word), words))
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bucket(names: list[str], table: int, masks: tuple[int, ...]) -> Column:
    bits = [F.col(n).bitwiseAND(F.lit(_signed(m)).cast("bigint")) for n, m in zip(names, masks, strict=True) if m]
    return F.xxhash64(F.lit(table), *bits)


def _tiles(rows: DataFrame, tile_rows: int, radius: int) -> DataFrame:
    """For each bucket and population count of ``rows``: the tiles that rows of that count are in, and the first and last tile with a count within the radius of it."""
    counts = rows.groupBy("bucket", "pop").agg(F.count("*").alias("n"))
    up = Window.partitionBy("bucket").orderBy("pop")
    before = F.sum("n").over(up) - F.col("n")
    tiles = counts.withColumn("low", F.floor(before / tile_rows)).withColumn("high", F.floor((before + F.col("n") - 1) / tile_rows))
    near = up.rangeBetween(-radius, radius)
    return tiles.select("bucket", "pop", "low", "high", F.min("low").over(near).alias("from"), F.max("high").over(near).alias("to"))


def _dealt(rows: DataFrame, names: list[str], tables: list[tuple[int, ...]], radius: int, carried: list[str], tile_rows: int | None) -> DataFrame:
    """Each row once for each tile pair that it takes part in, sorted by tile pair, side and population count.

    A bucket that has more than ``tile_rows`` rows is cut into tiles along their
    population counts; a row goes only to the pairs of its own tile with those
    that hold counts within the radius of its own. The tiles' bounds are a few
    dozen rows for each such bucket, and so many buckets are at most twice as many
    as tasks; they are broadcast behind a count.
    """
    tasks = shuffle_partitions(rows)
    if tile_rows is None:  # half of an even share
        tile_rows = min(TILE_ROWS[1], max(TILE_ROWS[0], rows.count() * len(tables) // (2 * tasks)))
    pop = sum((F.bit_count(n) for n in names[1:]), F.bit_count(names[0])).cast("int")
    keys = F.array(*[_bucket(names, t, m) for t, m in enumerate(tables)])
    spread = rows.select("node", "n_shingles", *names, *carried, pop.alias("pop"), F.posexplode(keys).alias("table", "bucket"))
    large = saved(spread.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > tile_rows).select("bucket"), "large")
    task, second = F.xxhash64("bucket"), F.lit(0)
    if not large.isEmpty():
        tiles = saved(_tiles(join_checked(spread.select("bucket", "pop"), large, ["bucket"], "left_semi"), tile_rows, radius), "tiles")
        spread = join_checked(spread, tiles, ["bucket", "pop"], "left")
        own = F.col("low") + F.pmod(F.xxhash64("node"), F.col("high") - F.col("low") + 1)
        spread = spread.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("low").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(F.sequence("from", "to"))))
        task = F.when(F.col("low").isNull(), task).otherwise(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")))
        second = F.coalesce(F.col("own") > F.col("other"), F.lit(False)).cast("int")
    routed = spread.select(task.alias("task"), second.alias("second"), "pop", F.col("table").cast("int").alias("table"), "node", "n_shingles", *names, *carried)
    return routed.repartition(tasks, "task").sortWithinPartitions("task", "second", "pop")


# ------------------------------------------------------------------ tiles
def _padded(key: np.ndarray, f: np.ndarray, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (tiles, SIDE) and fingerprints (words, tiles, SIDE), filled up to whole tiles."""
    short = -len(key) % SIDE
    return np.r_[key, np.full(short, fill)].reshape(-1, SIDE), np.concatenate([f, np.zeros((len(f), short), np.uint64)], axis=1).reshape(len(f), -1, SIDE)


def near_pairs(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray] | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs of rows of the same task within ``radius`` bits, and the bits in which they differ; without ``right`` of rows of ``left``, each pair once.

    ``left`` and ``right`` hold keys, in ascending order, and fingerprints (words
    by rows). A key is the number of the row's task times a stride, beyond all
    population counts and radii, plus its population count. Rows are cut into tiles
    in that order; a pair of tiles whose keys are further apart than the radius
    (other tasks, or population counts that differ by more) is skipped. The others
    are compared with exclusive-or and bit counts, many at once.
    """
    alone = right is None
    (lk, lf), (rk, rf) = left, left if alone else right
    if not len(lk) or not len(rk):
        return
    lt, lw = _padded(lk, lf, -(1 << 62))
    rt, rw = (lt, lw) if alone else _padded(rk, rf, -(1 << 62))
    last = lambda t, key: np.r_[t[:-1, -1], key[-1]]
    begin = np.arange(len(lt)) if alone else np.searchsorted(last(rt, rk), lt[:, 0] - radius)
    many = np.maximum(np.searchsorted(rt[:, 0], last(lt, lk) + radius, side="right") - begin, 0)
    a = np.repeat(np.arange(len(lt)), many)
    b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + begin[a]
    # So many words are compared at once that few rows come through by chance.
    head = next((k for k in range(1, len(lf)) if 32 * k - 16 * k**0.5 > radius), len(lf))
    step = max(1, TILE_PAIRS // head)
    for at in range(0, len(a), step):
        x, y = a[at : at + step], b[at : at + step]
        bits = np.zeros((len(x), SIDE, SIDE), np.uint8 if head < 4 else np.uint16)
        for p, q in zip(lw[:head], rw[:head], strict=True):
            bits += np.bitwise_count(p[x][:, :, None] ^ q[y][:, None, :])
        k, i, j = np.nonzero(bits <= radius)
        total = bits[k, i, j].astype(np.int64)
        i, j = x[k] * SIDE + i, y[k] * SIDE + j
        keep = (i < j) & (j < len(rk)) if alone else (i < len(lk)) & (j < len(rk))
        i, j, total = i[keep], j[keep], total[keep]
        keep = np.abs(lk[i] - rk[j]) <= radius
        i, j, total = i[keep], j[keep], total[keep]
        for p, q in zip(lf[head:], rf[head:], strict=True):
            total += np.bitwise_count(p[i] ^ q[j])
            keep = total <= radius
            i, j, total = i[keep], j[keep], total[keep]
        if len(i):
            yield i, j, total


def _whole_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole tasks: what follows the last change of the first column waits for the next batch."""
    held: list[list[np.ndarray]] = []

    def joined() -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*held, strict=True)]

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut or (held and held[-1][0][-1] != columns[0][0]):
            if cut:
                held.append([c[:cut] for c in columns])
            yield joined()
            held = []
        held.append([c[cut:] for c in columns])
    if held:
        yield joined()


def _task_pairs(columns: list[np.ndarray], words: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`near_pairs` over all tasks of the columns (from :func:`_dealt`), as row numbers."""
    task, second, pop = columns[0], columns[1].astype(bool), columns[2].astype(np.int64)
    f = np.stack(columns[6 : 6 + words]).view(np.uint64)
    cuts = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
    run = np.repeat(np.arange(len(cuts)), np.diff(np.r_[cuts, len(task)]))
    key = run * (64 * words + 2 * radius + 2) + pop
    split = np.logical_or.reduceat(second, cuts)[run]
    rows = np.flatnonzero(~split)
    for i, j, bits in near_pairs((key[rows], f[:, rows]), None, radius):
        yield rows[i], rows[j], bits
    if split.any():
        first, other = np.flatnonzero(split & ~second), np.flatnonzero(second)
        for i, j, bits in near_pairs((key[first], f[:, first]), (key[other], f[:, other]), radius):
            yield first[i], other[j], bits


def _forest_kernel(words: int, radius: int, ratio: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges that span what hangs together within the radius in each task, so that a large group gives no more of them than rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_tasks(batches):
            ids, sizes = columns[4], columns[5]
            a, b, held = [], [], 0
            for i, j, _ in _task_pairs(columns, words, radius):
                if ratio > 0:
                    keep = np.minimum(sizes[i], sizes[j]) >= ratio * np.maximum(sizes[i], sizes[j])
                    i, j = i[keep], j[keep]  # noqa: PLW2901
                a.append(i)
                b.append(j)
                held += len(i)
                if held > HELD_PAIRS:
                    x, y = forest(len(ids), np.concatenate(a), np.concatenate(b))
                    a, b, held = [x], [y], 0
            if a:
                x, y = forest(len(ids), np.concatenate(a), np.concatenate(b))
                yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y])], ["a", "b"])

    return run


def similar_groups(prints: DataFrame, words: int = 1, radius: int = 3, min_size_ratio: float = 0.0, tile_rows: int | None = None) -> DataFrame:
    """Group fingerprints that are linked, directly or over others, by ``radius`` differing bits or fewer.

    ``prints`` holds doc_id, f0.., n_shingles (from :func:`fingerprints`).
    Returns its rows with component_id, the smallest doc_id of the group. Equal
    fingerprints (with a size ratio: of equal sizes) are first grouped to one, so
    copies are never compared.

    The comparison is exact. Each distinct fingerprint goes into buckets, one for
    each of :func:`block_tables`; two within the radius share one at least. Within
    buckets rows are cut into tiles along their population counts, and pairs of
    tiles whose counts differ beyond the radius are skipped, within a task as well
    as in dealing a large bucket over tasks.

    Each task returns a forest over its rows, never all pairs. A null doc_id
    counts as the smallest of none: it groups like others but is no component_id
    unless its whole group is null. An empty table gives an empty table.
    """
    names = [f"f{k}" for k in range(words)]
    sizes = F.lit(0) if min_size_ratio <= 0 else F.col("n_shingles")
    distinct = saved(
        prints.groupBy(*names, sizes.cast("bigint").alias("n_shingles")).agg(F.min("doc_id").alias("low")).withColumn("node", F.xxhash64(*names, "n_shingles") if words > 1 or min_size_ratio > 0 else F.col("f0")),
        "prints",
    )
    placed = _dealt(distinct, names, block_tables(distinct.count(), radius, words), radius, [], tile_rows)
    labels = connected_components(placed.mapInArrow(_forest_kernel(words, radius, min_size_ratio), "a bigint, b bigint"))
    grouped = distinct.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    keyed = saved(grouped.join(lows, "component").select(*names, "n_shingles", "component_id"), "groups")
    return prints.withColumn("__n", sizes.cast("bigint")).join(keyed.withColumnRenamed("n_shingles", "__n"), [*names, "__n"], "left").drop("__n")


def simhash_groups(docs: DataFrame, shingle_words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts, and texts of blanks, have the fingerprint zero and are
    linked like any others. A very long text is hashed whole, at some 20 bytes of
    memory a word. Rows that repeat a doc_id are fingerprinted each for itself and
    linked like others. A null doc_id stays null (see :func:`similar_groups`).
    An empty table gives an empty table.
    """
    prints = saved(fingerprints(docs, shingle_words).select("doc_id", "f0", "n_shingles"), "fingerprints")
    out = similar_groups(prints, 1, radius)
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


# ------------------------------------------------------- similarity of sets
@dataclass(frozen=True)
class Likeness:
    """When two sets may be similar: at least ``ratio`` in size, and no more differing bits than the limit of the larger size (the last limit for all beyond)."""

    words: int
    ratio: float
    limits: np.ndarray

    @property
    def radius(self) -> int:
        return int(self.limits.max())

    def may(self, a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> np.ndarray:
        large = np.maximum(a, b)
        return (np.minimum(a, b) >= self.ratio * large) & (bits <= self.limits[np.minimum(large, len(self.limits) - 1)])


def _candidate_kernel(like: Likeness, tables: list[tuple[int, ...]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of the pairs of each task that may be similar: each row's closest partner (``closest``, and whether it had ``more``), and edges that span what hangs together.

    A pair counts only in the first table that brings it together.
    """
    words, masks = like.words, np.array(tables, np.uint64)

    def candidates(columns: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        table, sizes = columns[3], columns[5]
        f = np.stack(columns[6 : 6 + words]).view(np.uint64)
        for i, j, bits in _task_pairs(columns, words, like.radius):
            keep = like.may(sizes[i], sizes[j], bits)
            i, j, bits = i[keep], j[keep], bits[keep]  # noqa: PLW2901
            if len(i):
                differ = f[:, i] ^ f[:, j]
                seen = np.zeros(len(i), bool)
                for t in range(int(table[i].max())):
                    seen |= (table[i] > t) & ((differ & masks[t][:, None]) == 0).all(0)
                if not seen.all():
                    yield i[~seen], j[~seen], bits[~seen]

    def closest(ids: np.ndarray, i: np.ndarray, j: np.ndarray, bits: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((ids[j], bits, i))
        i, j, bits, more = i[order], j[order], bits[order], more[order]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        several = np.logical_or.reduceat(more, first) | (np.diff(np.r_[first, len(i)]) > 1)
        return i[first], j[first], bits[first], several

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_tasks(batches):
            ids = columns[4]
            best: list[tuple[np.ndarray, ...]] = []
            tree = np.empty(0, np.int64), np.empty(0, np.int64)
            for i, j, bits in candidates(columns):
                tree = forest(len(ids), np.r_[tree[0], i], np.r_[tree[1], j])
                best.append((np.r_[i, j], np.r_[j, i], np.r_[bits, bits], np.zeros(2 * len(i), bool)))
                if sum(len(x[0]) for x in best) > HELD_PAIRS:
                    best = [closest(ids, *map(np.concatenate, zip(*best, strict=True)))]
            if best:
                i, j, _, several = closest(ids, *map(np.concatenate, zip(*best, strict=True)))
                spanning = np.r_[np.zeros(len(i), bool), np.ones(len(tree[0]), bool)]
                a, b = np.r_[i, tree[0]], np.r_[j, tree[1]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(~spanning), pa.array(np.r_[several, np.zeros(len(tree[0]), bool)])], ["a", "b", "closest", "more"])

    return run


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two sets as ascending arrays; that of two empty ones is 1."""
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / (len(x) + len(y) - shared) if len(x) or len(y) else 1.0


def _family_kernel(like: Likeness) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads rows of task, second, node, n_shingles, component, hashes, f0.., sorted by task; gives the links that join the components of a task.

    Pairs that may be similar are tested on their sets, the closest first, but for
    those that hang together already.
    """

    def links(columns: list[np.ndarray], hashes: list[bytes]) -> tuple[list[int], list[int]]:
        second, ids, sizes, component = columns[1].astype(bool), columns[2], columns[3], columns[4]
        f = np.stack(columns[5:]).view(np.uint64)
        pop = np.bitwise_count(f).sum(0, dtype=np.int64)
        of = lambda rows: rows[np.argsort(pop[rows], kind="stable")]
        left, right = of(np.flatnonzero(~second)), of(np.flatnonzero(second))
        part = lambda rows: (pop[rows], f[:, rows])
        other = left if not len(right) else right
        label = {int(c): int(c) for c in np.unique(component).tolist()}

        def find(c: int) -> int:
            while label[c] != c:
                label[c] = c = label[label[c]]
            return c

        a, b = [], []
        for i, j, bits in near_pairs(part(left), part(right) if len(right) else None, like.radius):
            i, j = left[i], other[j]  # noqa: PLW2901
            keep = (component[i] != component[j]) & like.may(sizes[i], sizes[j], bits)
            i, j, bits = i[keep], j[keep], bits[keep]  # noqa: PLW2901
            order = np.argsort(bits, kind="stable")
            for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
                p, q = find(int(component[x])), find(int(component[y]))
                if p != q and _jaccard(np.frombuffer(hashes[x], np.uint64), np.frombuffer(hashes[y], np.uint64)) >= like.ratio * (1 - 1e-12):
                    label[max(p, q)] = min(p, q)
                    a.append(int(ids[x]))
                    b.append(int(ids[y]))
        return a, b

    def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held)
        hashes = whole["hashes"].to_pylist()
        a, b = links([c.to_numpy() for c in whole.drop_columns("hashes").columns], hashes)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            task = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)] if len(task) else [0]
            for s, e in pairwise(cuts):
                if held and held[-1].column(0)[0].as_py() != task[s]:
                    yield emit(held)
                    held = []
                held.append(batch.slice(s, e - s))
        if held:
            yield emit(held)

    return run


#: Rows of a family of possibly similar sets, with their sets, that a task compares, at least and at most.
FAMILY_ROWS = (64, 1024)


def verified_groups(prints: DataFrame, texts: DataFrame, shingle_words: int, words: int, min_similarity: float, tile_rows: int | None = None) -> DataFrame:
    """node, component of all sets that are linked by a Jaccard similarity of ``min_similarity`` or more.

    ``prints`` holds row, node, n_shingles and the fingerprints of sets, ``texts``
    row and text. Fingerprints only pick candidates, among buckets of agreeing bits
    (:func:`sampled_tables`); links are tested on the sets themselves. First each
    row's closest candidate in each task is tested, which already makes few
    components of a large group of near copies. A family is what hangs together
    over all candidates. Where one holds several components and untested
    candidates, its rows are dealt, with their sets, over pairs of tiles, and what
    may join two components is tested there: pairs never leave a task unless they
    are links that join something.
    """
    names = [f"f{k}" for k in range(words)]
    like = Likeness(words, min_similarity, candidate_limits(min_similarity, 64 * words))
    nodes = saved(prints.groupBy("node").agg(F.min("row").alias("row"), F.first("n_shingles").alias("n_shingles"), *[F.first(n).alias(n) for n in names]), "nodes")
    tables = sampled_tables(nodes.count(), differing_share(min_similarity), words)
    placed = _dealt(nodes, names, tables, like.radius, [], tile_rows)
    found = saved(placed.mapInArrow(_candidate_kernel(like, tables), "a bigint, b bigint, closest boolean, more boolean"), "candidates")
    pairs = saved(found.where("closest").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    sets = shingle_sets(pairs, nodes, texts, shingle_words)
    links = saved(similar_pairs(pairs, sets, min_similarity), "links")
    labels = saved(connected_components(links), "labels")

    family = saved(connected_components(found.select("a", "b")).withColumnRenamed("component", "family"), "families")
    more = found.where("more").select(F.col("a").alias("node")).distinct().withColumn("more", F.lit(True))
    member = family.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    member = saved(member.join(more, "node", "left").select("node", "family", "component", F.coalesce("more", F.lit(False)).alias("more")), "members")
    parted = member.groupBy("family").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("more").alias("more"), F.count("*").alias("n"))
    parted = saved(parted.where("more and low <> high").select("family", "n"), "parted")
    rows = join_checked(member.select("node", "family", "component"), parted.select("family"), ["family"], "left_semi").withColumnRenamed("family", "bucket")
    tasks = shuffle_partitions(prints)
    share = (parted.agg(F.sum("n")).first()[0] or 0) // (2 * tasks)
    size = tile_rows or min(FAMILY_ROWS[1], max(FAMILY_ROWS[0], share))
    tiles = saved(parted.select(F.col("family").alias("bucket"), F.ceil(F.col("n") / size).cast("bigint").alias("m")).where("m > 1"), "tiles")
    rows = rows.join(nodes.drop("row"), "node").join(sets, "node")
    dealt = dealt_to_tile_pairs(rows, tiles).select(F.xxhash64("bucket", "pair.low", "pair.high").alias("task"), F.col("pair.second").cast("int").alias("second"), "node", "n_shingles", "component", "hashes", *names)
    dealt = bounded_batches(dealt.repartition(tasks, "task").sortWithinPartitions("task"))
    return connected_components(links.unionByName(dealt.mapInArrow(_family_kernel(like), "a bigint, b bigint")))


def shingle_sets(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle_words: int) -> DataFrame:
    """node and hashes (ascending, eight bytes each) of the shingle set of every node in ``pairs`` (a, b)."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = saved(nodes.select("node", "row").join(used, "node", "left_semi"), "used")
    found = join_checked(texts.select("row", "text"), rows, ["row"], "inner").select("node", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(text or b"", shingle_words)).tobytes() for text in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "hashes"])

    # Rows that are alike have one node.
    return saved(bounded_batches(found).mapInArrow(hashed, "node bigint, hashes binary").dropDuplicates(["node"]), "sets")


def similar_pairs(pairs: DataFrame, sets: DataFrame, min_similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose ``sets`` (node, hashes) have at least the given Jaccard similarity."""
    both = pairs.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b").select("a", "b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            keep = [_jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= min_similarity * (1 - 1e-12) for x, y in found]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return bounded_batches(both).mapInArrow(run, "a bigint, b bigint")


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, min_similarity: float = 0.8, words: int = WORDS) -> DataFrame:
    """Keep one row of each group of near-duplicates: that of the smallest doc_id. Columns stay as they are, whatever their names.

    Rows are linked if the sets of their ``shingle_words``-word shingles have a
    Jaccard similarity of ``min_similarity`` or more. Fingerprints of ``words``
    times 64 bits over those sets only pick the candidates (see
    :func:`verified_groups`); each candidate pair is then tested on the sets
    themselves, so no link is false, and a pair at the threshold is missed about
    once in four hundred. Null and empty texts, and texts of blanks, form one
    group. A very long text is hashed whole. An empty table gives an empty table.

    Each row is a document of its own. In a group rows with a number come before
    those without, numbers that only one set has before those that several have,
    then the smallest doc_id, set and text. Of rows that repeat a doc_id and are
    each kept by their group, one stays; null doc_ids are no such repeats.
    """
    number, text = F.col("doc_id").cast("bigint"), F.col("text").cast("string")
    (key,) = unused(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64(number.isNull(), number, text.isNull(), text))
    texts = keyed.select(F.col(key).alias("row"), number.alias("doc_id"), text.alias("text"))
    prints = saved(fingerprints(texts, shingle_words, words, distinct=True, carry=("row", "doc_id")), "fingerprints")
    labels = saved(verified_groups(prints, texts, shingle_words, words, min_similarity), "labels")
    rows = saved(prints.groupBy("row", "doc_id", "node").agg(F.count("*").alias("times")), "rows")
    grouped = saved(join_checked(rows, labels, ["node"], "left").select("row", "node", "doc_id", F.coalesce("component", "node").alias("component")), "grouped")
    repeated = saved(grouped.where("doc_id is not null").groupBy("doc_id").agg(F.countDistinct("node").alias("sets")).where("sets > 1").select("doc_id", F.lit(True).alias("again")), "repeated")
    order = F.struct(F.col("doc_id").isNull().alias("unnumbered"), F.coalesce("again", F.lit(False)).alias("again"), "doc_id", "node", "row")
    kept = join_checked(grouped, repeated, ["doc_id"], "left").groupBy("component").agg(F.min(order).alias("k")).select("k.*")
    once = kept.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("node", "row")).alias("k")).select("k.row")
    kept = saved(once.unionByName(kept.where("doc_id is null").select("row")), "kept")
    lost = saved(rows.select("row").join(kept, "row", "left_anti").withColumnRenamed("row", key), "lost")
    out = join_checked(keyed, lost, [key], "left_anti")
    many = saved(rows.where("times > 1").select(F.col("row").alias(key)), "many")
    if not many.isEmpty():  # rows that are alike in number and text; of each such one stays
        out = join_checked(out, many, [key], "left_anti").unionByName(join_checked(out, many, [key], "left_semi").dropDuplicates([key]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def differing_share(similarity: float) -> float:
    """Share of the bits in which the fingerprints of two large sets of equal size and that Jaccard similarity differ."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


@functools.lru_cache(maxsize=8)
def candidate_limits(similarity: float, bits: int, errors: float = 3.0) -> np.ndarray:
    """By the size of the larger set (the last entry for all beyond), the differing bits of a pair at least so similar, plus ``errors`` standard errors.

    A bit is the majority of as many coins as there are shingles. For small sets
    the share of bits that differ is counted out over all sizes and overlaps the
    similarity allows, as ties weigh much there; for large ones it is the angle.
    """
    def more_than(n: int) -> np.ndarray:
        """P(at least k heads of n) for k = 0..n+1."""
        p = np.array([comb(n, k) for k in range(n + 1)], float) / 2.0**n
        return np.r_[np.cumsum(p[::-1])[::-1], 0.0]

    def differ(a: int, b: int, c: int) -> float:
        both = np.array([comb(c, k) for k in range(c + 1)], float) / 2.0**c
        one = lambda n: more_than(n - c)[np.clip(n // 2 + 1 - np.arange(c + 1), 0, n - c + 1)]
        x, y = one(a), one(b)
        return float((both * (x * (1 - y) + y * (1 - x))).sum())

    shares = np.zeros(EXACT_SIZES + 1)
    for b in range(1, EXACT_SIZES):
        for a in range(ceil(similarity * b - 1e-9), b + 1):
            c = ceil(similarity * (a + b) / (1 + similarity) - 1e-9)
            shares[b] = max([shares[b], *(differ(a, b, x) for x in range(c, a + 1))])
    shares[-1] = max(differing_share(similarity), shares[EXACT_SIZES // 2 : -1].max())
    return (bits * shares + errors * np.sqrt(bits * shares * (1 - shares))).astype(np.int64)


def radius_for(similarity: float, bits: int) -> int:
    """Differing bits that stand for a Jaccard similarity: the angle between sets of equal size, plus one standard error."""
    share = differing_share(similarity)
    return int(bits * share + (bits * share * (1 - share)) ** 0.5)
