"""Catalog pools, source groups and their allocation to splits."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chirplake.config import DEFAULT, FILE_SECONDS
from chirplake.functions import draws
from chirplake.functions import scalars as S
from chirplake.operators.scratch import saved


def confident(rows: DataFrame, confidence: Column, least: float, ifos: tuple[str, ...] = (), labels: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the detectors and labels (none given: all) with a time, whose confidence is high enough or cannot be read."""
    keep = F.coalesce(F.isnan(confidence) | (confidence >= least), F.lit(True)) & F.col("gps").isNotNull()
    if ifos:
        keep = keep & F.col("ifo").isin(*ifos)
    if labels:
        keep = keep & F.col("label").isin(*labels)
    return rows.where(keep)


def capped(rows: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each key in arrival order. Rows without a time do not count; Spark limits each task's groups before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.where("gps is not null").withColumn("__place", place).where(F.col("__place") <= limit).drop("__place")


def group_counts(pool: DataFrame) -> DataFrame:
    return pool.groupBy("ifo", "grp").agg(F.count("*").alias("n"))


def assign_groups(counts: DataFrame, ratios: dict[str, float] | None = None) -> DataFrame:
    """Allocate the groups of each detector, largest first, to the split that lacks most rows.

    Ties between groups go by a hash, between splits by their order. The choice
    is sequential; its input is one row per 4096 s file, some thousands a year of
    observation, however many events the pool has.
    """
    ratios = ratios or DEFAULT.ratios
    names = list(ratios)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _largest_first(pdf, names, [float(pdf["n"].sum()) * ratios[s] for s in names])

    keyed = counts.withColumn("tie", draws.rank_hash("group", F.col("grp")))
    return keyed.groupBy("ifo").applyInPandas(run, "ifo string, grp string, n bigint, split string")


def _largest_first(pdf: pd.DataFrame, names: list[str], lacking: list[float]) -> pd.DataFrame:
    pdf = pdf.sort_values(["n", "tie", "grp"], ascending=[False, True, True], ignore_index=True)
    out = []
    for n in pdf["n"].tolist():
        best = max(range(len(names)), key=lacking.__getitem__)
        lacking[best] -= n
        out.append(names[best])
    return pdf.assign(split=out)[["ifo", "grp", "n", "split"]]


def assign_many(counts: DataFrame, ratios: dict[str, float] | None = None, have: DataFrame | None = None, heavy: float = 1 / 16) -> DataFrame:
    """Allocate any number of groups, beside what the splits already have: ifo, grp, n, split.

    ``counts`` has ifo, grp, n for the groups to allocate, ``have`` (ifo, split, n) the rows
    that each split holds already. A split lacks its ratio of all rows, old and new, less
    what it holds. Groups with at least ``heavy`` of their detector's new rows, of which
    there are at most 1 / ``heavy``, go first, the largest first, each to the split that lacks
    most. The others lie in the order of a hash, and the splits take stretches of that
    order in proportion to what they then lack; a group belongs where its middle row
    lies. Places in the order are sums over buckets of hashes (65,536 a detector) and windows within
    them, so no task sees all groups.
    """
    ratios = ratios or DEFAULT.ratios
    names = list(ratios)
    spark = counts.sparkSession
    keyed = counts.withColumn("tie", draws.rank_hash("group", F.col("grp")))
    new = counts.groupBy("ifo").agg(F.sum("n").alias("__new"))
    share = lambda table: table.groupBy("ifo").agg(*[F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(f"__{s}") for s in names])
    held = share(have if have is not None else spark.createDataFrame([], "ifo string, split string, n bigint"))
    lacking = new.join(F.broadcast(held), "ifo", "left").fillna(0)
    every = sum((F.col(f"__{s}") for s in names), F.col("__new"))
    lacking = lacking.select("ifo", "__new", *[(every * F.lit(ratios[s]) - F.col(f"__{s}")).alias(f"__{s}") for s in names])
    rows = keyed.join(F.broadcast(lacking), "ifo")  # a row a detector
    large = F.col("n") >= F.col("__new") * heavy

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _largest_first(pdf, names, [float(pdf[f"__{s}"].iloc[0]) for s in names])

    first = rows.where(large).groupBy("ifo").applyInPandas(run, "ifo string, grp string, n bigint, split string")
    first = saved(first, "heavy")
    given = F.broadcast(share(first).select("ifo", *[F.col(f"__{s}").alias(f"__got_{s}") for s in names]))
    light = rows.where(~large).join(given, "ifo", "left").fillna(0)
    left = [F.greatest(F.col(f"__{s}") - F.col(f"__got_{s}"), F.lit(0.0)) for s in names]
    bucket = F.substring("tie", 1, 4)
    sizes = light.groupBy("ifo", bucket.alias("__bucket")).agg(F.sum("n").alias("__rows"))
    over = Window.partitionBy("ifo").orderBy("__bucket")
    starts = sizes.select("ifo", "__bucket", F.coalesce(F.sum("__rows").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"), F.sum("__rows").over(Window.partitionBy("ifo")).alias("__light"))
    within = Window.partitionBy("ifo", "__bucket").orderBy("tie", "grp").rowsBetween(Window.unboundedPreceding, -1)
    placed = light.withColumn("__bucket", bucket).join(starts, ["ifo", "__bucket"])
    middle = (F.col("__start") + F.coalesce(F.sum("n").over(within), F.lit(0)) + F.col("n") / 2) / F.col("__light")
    placed = placed.withColumn("__at", middle)
    split: Column | None = None
    total = sum(left[1:], left[0])
    for k, name in enumerate(names[:-1]):
        reach = F.col("__at") * total < sum(left[1 : k + 1], left[0])
        split = F.when(reach, name) if split is None else split.when(reach, name)
    last = F.lit(names[-1]) if split is None else split.otherwise(names[-1])
    return first.unionByName(placed.select("ifo", "grp", "n", last.alias("split")))


def coverage(pool: DataFrame, assignment: DataFrame, splits: tuple[str, ...], ifos: tuple[str, ...]) -> DataFrame:
    """Rows of the pool for every split and detector, zero where there are none."""
    spark = pool.sparkSession
    need = spark.createDataFrame([(s, i) for s in splits for i in ifos], "split string, ifo string")
    have = assignment.groupBy("split", "ifo").agg(F.sum("n").alias("rows"), F.count("*").alias("files"))
    out = F.broadcast(need).join(have, ["split", "ifo"], "left")
    return out.select("split", "ifo", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"), F.coalesce("files", F.lit(0)).cast("bigint").alias("files"))


def pool_rows(pool: DataFrame, assignment: DataFrame, listed: DataFrame | None = None, split: str | None = None) -> DataFrame:
    """Pool rows with the split of their source group (one split's only, if named), without the listed segments.

    The assignment has a row per source file, so Spark may well broadcast it.
    """
    rows = pool.join(assignment.select("grp", "split"), "grp")
    if split is not None:
        rows = rows.where(F.col("split") == split)
    if listed is not None:
        rows = not_listed(rows.withColumn("key", S.gps_key(F.col("ifo"), F.col("gps"))), listed, ["key"]).drop("key")
    return rows


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Number rows from 0 within each key in the given order, whose first column names blocks of rows (source files).

    Rows are numbered within their blocks, and the running sum is over one row a
    block, so that no task sorts all rows of a key.
    """
    block, *rest = order
    sizes = rows.groupBy(*keys, block).agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*keys, block, F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(*keys, block).orderBy(*rest)) - 1
    return rows.join(starts, [*keys, block]).withColumn(name, (F.col("__before") + within).cast("bigint")).drop("__before")


def picked(wanted: DataFrame, candidates: DataFrame, keys: list[str], order: list[str], draw: Column) -> DataFrame:
    """For each wanted row one of its key's candidates, evenly drawn with replacement; rows without any are left out. See :func:`numbered` for the order."""
    sizes = candidates.groupBy(*keys).agg(F.count("*").alias("__n"))
    asked = wanted.join(F.broadcast(sizes), keys).withColumn("__i", F.floor(draw * F.col("__n")).cast("bigint")).drop("__n")
    return asked.join(numbered(candidates, keys, order, "__i"), [*keys, "__i"]).drop("__i")


def uncovered(found: DataFrame) -> DataFrame:
    return found.where("rows = 0")


def offsource_grid(groups: DataFrame, halfwin: float = DEFAULT.halfwin, step: float = DEFAULT.grid_step) -> DataFrame:
    """Points at which a segment fits into its file: ifo, grp, gps. ``groups`` has ifo, grp, fid."""
    points = int((FILE_SECONDS - 2 * halfwin) // step)
    start = F.col("fid") * FILE_SECONDS + F.lit(float(halfwin))
    spread = groups.select("ifo", "grp", "fid", F.explode(F.sequence(F.lit(0), F.lit(points))).alias("k"))
    return spread.select("ifo", "grp", (start + F.col("k") * F.lit(float(step))).alias("gps"))


def outside(points: DataFrame, events: DataFrame, exclusion: float = DEFAULT.exclusion) -> DataFrame:
    """Points (ifo, gps, ...) that no event of the detector is closer to than ``exclusion``.

    A range anti join: time is cut into buckets as long as the exclusion, so a
    close event lies in the point's bucket or one beside it. Each event goes to
    its three buckets once, and the rest is an equi join with a residual test.
    """
    b = F.floor(F.col("gps") / exclusion).cast("bigint")
    near = events.where("gps is not null").select("ifo", F.col("gps").alias("__event"), F.explode(F.array(b - 1, b, b + 1)).alias("__b")).distinct()
    keyed = points.withColumn("__b", b)
    close = (keyed["ifo"] == near["ifo"]) & (keyed["__b"] == near["__b"]) & (F.abs(keyed["gps"] - near["__event"]) < exclusion)
    return keyed.join(near, close, "left_anti").drop("__b")


def cached_first(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the cached candidates if there are any, else all (column ``cached``, boolean)."""
    some = candidates.groupBy(*keys).agg(F.max("cached").alias("__some"))
    return candidates.join(some, keys).where(F.col("cached") == F.col("__some")).drop("__some")


def not_listed(rows: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(listed.select(*keys).distinct(), keys, "left_anti")


def greedy_files(pool: DataFrame, per_detector: int) -> DataFrame:
    """Whole files of each detector, the fullest first (then the first seen), until ``per_detector`` rows are taken: ifo, fid, n, taken."""
    files = pool.groupBy("ifo", "fid").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))
    w = Window.partitionBy("ifo").orderBy(F.col("n").desc(), "first_ord").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("taken", F.col("before") < per_detector)


def subset_files(pool: DataFrame, per_detector: int) -> DataFrame:
    """The files of :func:`greedy_files` and, for each class these miss, in order, the unpicked file that holds most of it.

    A class is still topped up after an earlier top-up has covered it, as the
    choice looks at the greedy pass only. Works on counts per file and class.
    """
    files = greedy_files(pool, per_detector).select("ifo", "fid", "first_ord", "taken")
    rows = pool.groupBy("ifo", "fid", "label").agg(F.count("*").alias("n")).join(files, ["ifo", "fid"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        count = {(r.fid, r.label): r.n for r in pdf.itertuples()}
        order = pdf.sort_values("first_ord", kind="stable")["fid"].drop_duplicates().tolist()
        picked = {f: "greedy" for f in pdf.loc[pdf["taken"], "fid"].unique().tolist()}
        have = set(pdf.loc[pdf["taken"], "label"])
        for label in sorted(set(pdf["label"]) - have):
            rest = [f for f in order if f not in picked]
            if rest:
                picked[max(rest, key=lambda f: count.get((f, label), 0))] = f"topup:{label}"
        return pd.DataFrame({"ifo": pdf["ifo"].iloc[0], "fid": list(picked), "reason": list(picked.values())})

    return rows.groupBy("ifo").applyInPandas(run, "ifo string, fid bigint, reason string")


def subset(pool: DataFrame, per_detector: int) -> DataFrame:
    return pool.join(subset_files(pool, per_detector), ["ifo", "fid"])


def prefetch_outcomes(rows: DataFrame, cache: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Counts per outcome of a resumable fetch over the distinct segments of ``rows`` (ifo, gps), before anything is fetched."""
    return marked_segments(rows, cache, blacklist).groupBy("ifo", "outcome").agg(F.count("*").alias("n"))


def marked_segments(rows: DataFrame, cache: DataFrame, blacklist: DataFrame) -> DataFrame:
    """The distinct segments of ``rows`` (ifo, gps) with key and outcome: unavailable (listed), cached, or to_fetch."""
    wanted = rows.select("ifo", "gps", S.gps_key(F.col("ifo"), F.col("gps")).alias("key")).dropDuplicates(["key"])
    marked = wanted.join(cache.select("key").distinct().withColumn("__hit", F.lit(True)), "key", "left")
    marked = marked.join(blacklist.select("key").distinct().withColumn("__bad", F.lit(True)), "key", "left")
    outcome = F.when(F.col("__bad"), "unavailable").when(F.col("__hit"), "cached").otherwise("to_fetch")
    return marked.select("ifo", "gps", "key", outcome.alias("outcome"))


def first_accepted(keys: DataFrame, attempts: int, evaluate: Callable[[DataFrame], DataFrame], carry: list[str] | None = None) -> DataFrame:
    """Bounded rejection sampling: all attempts of a key are rows at once, and the first accepted one is kept, with the columns of ``carry``.

    ``evaluate`` gets rows with ``attempt`` and adds ``accepted``, at most one row for each of them; keys none of
    whose attempts is accepted come back with nulls. Keys are dealt over all partitions
    before they become rows of attempts, however few files they come from, and where ``evaluate`` leaves them
    there, no attempt is shuffled or sorted: a partition holds one best attempt a key. (Whole segments are drawn in
    rounds instead, see :mod:`segments`.)
    """
    dealt = keys.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys.columns)
    tried = evaluate(dealt.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1)))))
    best = tried.where("accepted").groupBy(*keys.columns).agg(F.min("attempt").alias("attempt"), *[F.min_by(c, "attempt").alias(c) for c in carry or []])
    return dealt.join(best, keys.columns, "left")
