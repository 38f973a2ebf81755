"""Exact global ranks and dense numbers without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_rank(df: DataFrame, digest: Column, tie: Column, name: str = "rank") -> DataFrame:
    """Rank (from 1) by a hex digest: rows fall into 65,536 buckets by its first four digits.

    The buckets' sizes are a table of a fixed bound, so its running sum and its
    broadcast stay small whatever the input; ranks within a bucket are a window
    over that bucket alone.
    """
    keyed = df.withColumn("__digest", digest).withColumn("__bucket", F.substring("__digest", 1, 4))
    sizes = keyed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__bucket", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__bucket").orderBy("__digest", tie))
    return keyed.join(F.broadcast(starts), "__bucket").withColumn(name, (F.col("__before") + within).cast("bigint")).drop("__digest", "__bucket", "__before")


def rank_cuts(df: DataFrame, digest: Column, tie: Column, upto: Column, name: str = "cuts") -> DataFrame:
    """One row: for each rank in the array ``upto`` (an expression of ``__total``, the number of rows) the row that holds it in the order of (digest, tie), or null.

    ``tie`` is a key of the rows. A rank is at most a cut's if (digest, tie) is at most the cut's
    (:func:`within_cut`), so rows are dealt by rank and neither shuffled nor sorted: of 4,096 buckets
    by the first three digits, only those that hold a cut are. The buckets' sizes are read in one task.
    """
    keyed = df.select(digest.alias("digest"), tie.alias("tie")).withColumn("__bucket", F.substring("digest", 1, 3))
    sizes = keyed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    whole = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upper = F.sum("__n").over(whole.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    wanted = sizes.withColumn("__upper", upper).withColumn("__total", F.sum("__n").over(whole)).select("*", F.posexplode(upto).alias("__place", "__upto"))
    wanted = wanted.where((F.col("__upto") > F.col("__upper") - F.col("__n")) & (F.col("__upto") <= F.col("__upper")))
    wanted = wanted.select("__bucket", "__place", (F.col("__upto") - F.col("__upper") + F.col("__n")).alias("__at"))
    within = F.row_number().over(Window.partitionBy("__place").orderBy("digest", "tie"))
    held = keyed.join(F.broadcast(wanted), "__bucket").withColumn("__r", within).where("__r = __at")
    return held.agg(F.map_from_entries(F.collect_list(F.struct("__place", F.struct("digest", "tie")))).alias(name))


def within_cut(digest: Column, tie: Column, cut: Column) -> Column:
    """Whether a row's rank is at most that of a cut of :func:`rank_cuts`."""
    return (digest < cut["digest"]) | ((digest == cut["digest"]) & (tie <= cut["tie"]))


#: Blocks whose sizes one task adds up when rows are numbered.
SUPER_BLOCK = 10_000


def block_starts(sizes: DataFrame, lead: list[str]) -> DataFrame:
    """Rows before each block, of sizes (lead, __super, __block, __n), in the order of (lead, __block): blocks are added up within super-blocks, and only these in one task."""
    above = [*lead, "__super"]
    until = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    supers = sizes.groupBy(*above).agg(F.sum("__n").alias("__n")).select(*above, until(Window.orderBy(*above)).alias("__first"))
    starts = sizes.withColumn("__before", until(Window.partitionBy(*above).orderBy("__block"))).join(supers, above)
    return starts.select(*above, "__block", (F.col("__first") + F.col("__before")).alias("__before"))


def dense_number(df: DataFrame, lead: list[str], block: Column, order: list[Column], name: str) -> DataFrame:
    """Number rows from 1 in the order (lead, block, order), where ``block`` grows with ``order``.

    Rows are numbered within blocks, blocks within super-blocks of ``SUPER_BLOCK``
    of them, and only the super-blocks' sizes are added up in one task; choose
    blocks of thousands of rows.
    """
    keys = [*lead, "__super", "__block"]
    keyed = df.withColumn("__block", block).withColumn("__super", F.floor(F.col("__block") / SUPER_BLOCK))
    starts = block_starts(keyed.groupBy(*keys).agg(F.count("*").alias("__n")), lead)
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    numbered = keyed.join(starts, keys)
    return numbered.withColumn(name, (F.col("__before") + within).cast("bigint")).drop("__block", "__super", "__before")


def quota_sizes(total: Column, ratios: dict[str, float]) -> Column:
    """Largest-remainder sizes as array<struct<name, size>> in the order of ``ratios``.

    What flooring leaves goes one by one to the largest fraction, then the
    larger ratio, then the earlier name.
    """
    parts = [F.struct(F.lit(name).alias("name"), F.lit(k).alias("place"), F.lit(r).alias("ratio"), F.floor(total * r).cast("bigint").alias("base"), (total * r - F.floor(total * r)).alias("left")) for k, (name, r) in enumerate(ratios.items())]
    every = F.array(*parts)
    spare = total - F.aggregate(every, F.lit(0).cast("bigint"), lambda s, p: s + p["base"])
    ahead = lambda p: F.size(F.filter(every, lambda q: (q["left"] > p["left"]) | ((q["left"] == p["left"]) & ((q["ratio"] > p["ratio"]) | ((q["ratio"] == p["ratio"]) & (q["place"] < p["place"]))))))
    return F.transform(every, lambda p: F.struct(p["name"].alias("name"), (p["base"] + F.when(ahead(p) < spare, 1).otherwise(0)).cast("bigint").alias("size")))
