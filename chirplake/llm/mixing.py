"""Mixing sources to target weights, with DataFrame functions only.

A corpus holds its sources in the sizes that they happen to have. A mix wants so
many words of each: some sources go in several times, of others only a part.
Words are dealt in blocks of equal length. Sainte-Lague apportionment, which gives
each block to whoever has the highest quotient of target over twice the blocks
that it has plus one, says how many blocks each shard of each source gives, and a
seeded hash of the blocks says which.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chirplake.llm.util import join_checked, running, saved, shuffle_partitions, unused

#: A word is a run of other characters than 0x20 and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in their order, repeating (fixed values).
WEIGHTS = (5, 2, 1)
#: Words of a block.
BLOCK = 16
#: Words that a shard of a source holds, about; a shard is what one task has to put in order.
SHARD_WORDS = 1 << 18


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """Words to take of each source: source, rank (from 0), source_size, target.

    ``sources`` has source and source_size, a row each. By code point, null last,
    sources weigh ``weights``, repeating, and share ``share`` times all words by
    weight, but none gets more than ``limit`` times its own size; what is beyond
    goes to the others by weight. That is one level for all: a source gets its
    weight times the level, or its limit. In the order of limit over weight, the
    level is the largest that follows from taking all earlier sources as stopped
    and that the source at hand does not stop below. Two running sums over ranges
    of the sources; no task sees all of them.
    """
    known = sources.agg(F.sum("source_size").alias("words"), F.count("*").alias("n")).first()
    total, every = known["words"] or 0, sum(weights) * (known["n"] // len(weights)) + sum(weights[: known["n"] % len(weights)])
    ranked = running(sources, [F.col("source").asc_nulls_last()], "ranks").withColumnRenamed("place", "rank")
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("bigint"))
    stop = F.col("source_size") * F.lit(float(limit)) / F.col("weight")
    order = [F.col("stop"), F.col("rank")]
    stopped = running(weighed.withColumn("stop", stop), order, "levels", sums=("source_size", "weight"))
    level = (F.lit(total * float(share)) - F.col("source_size_before") * F.lit(float(limit))) / (F.lit(every) - F.col("weight_before"))
    top = stopped.select(level.alias("level"), "stop").where("level <= stop").agg(F.max("level").alias("m")).first()["m"]
    target = F.least(F.col("source_size") * F.lit(float(limit)), F.col("weight") * F.lit(float(top) if top is not None else float("inf")))
    return stopped.select("source", "rank", "source_size", target.alias("target"))


def apportioned(cells: DataFrame, count: int, total: float) -> DataFrame:
    """Add ``quota``: ``count`` blocks dealt over the cells (rank, shard, wanted) to the highest quotients wanted / (2 j - 1) of their j-th block.

    Equal quotients go to the smaller rank, then the smaller shard. Two divisors
    enclose the one that deals out just ``count`` blocks: with the larger, rounding
    gives too few whatever it does, with the smaller too many. Blocks above both are
    granted, blocks below both are not, and only those between, some two for each
    cell, are put in order. ``total`` is the sum of ``wanted``.
    """
    n = cells.count()
    low = count - n / 2 - 1
    rounded = lambda divisor: F.floor(F.col("wanted") / F.lit(divisor) + 0.5).cast("bigint")
    some = total > 0
    bounded = cells.withColumn("granted", rounded(total / low) if some and low > 0 else F.lit(0).cast("bigint")).withColumn("possible", rounded(total / (count + n / 2 + 1)) if some else F.lit(0).cast("bigint"))
    bounded = saved(bounded, "bounded")
    left = count - (bounded.agg(F.sum("granted").alias("g")).first()["g"] or 0)
    between = bounded.where("possible > granted").select("rank", "shard", F.explode(F.sequence(F.col("granted") + 1, F.col("possible"))).alias("j"), "wanted")
    between = between.select("rank", "shard", "j", (F.col("wanted") / (2 * F.col("j") - 1)).alias("quotient"))
    dealt = running(between, [F.col("quotient").desc(), F.col("rank"), F.col("shard"), F.col("j")], "quotients").where(F.col("place") < left)
    more = dealt.groupBy("rank", "shard").agg(F.count("*").alias("more"))
    return bounded.join(more, ["rank", "shard"], "left").withColumn("quota", F.col("granted") + F.coalesce("more", F.lit(0))).drop("granted", "possible", "more")


def _block_hash(rank: Column, shard: Column, block: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("block"), rank.cast("string"), shard.cast("string"), block.cast("string")))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, limit: int = 2, seed: int = 42, carry: Sequence[str] = ()) -> DataFrame:
    """How often, and which words of, each document go into the mix.

    ``docs`` needs doc_id, source, text; ``carry`` names columns of it to keep. Returns a
    row for each of its rows: doc_id, source, size (words), source_size, target (its
    source's), repeats (times that the whole document goes in), pieces
    array<struct<first, words>> (stretches of words that go in once more) and taken
    (words in all, ``limit`` times size at most).

    Documents are dealt over shards of their source by a hash of doc_id and text, as
    many as its words fill, so that a source with a third of all rows is as many
    shards. A source whose target stopped at the limit gives all of its words that often.
    The blocks of all others are apportioned to their shards. Within a shard, documents
    lie in the order of the hash and are cut into blocks of ``BLOCK`` words, the last of
    which may be shorter; a shard gives all blocks as often as its quota goes into
    their number, and those with the smallest seeded hashes once more.

    A null text has no words, like an empty one, and is not taken; a document without
    words passes by all shards. A null source is one of its own, the last. Rows that
    repeat a doc_id are documents of their own; rows that repeat its text too lie side by
    side in one shard. A very long text is one row of its shard, and its blocks one
    array. An empty table gives an empty table. Columns of ``docs`` that are not named,
    whatever their names, play no part.
    """
    doc_id, source, text = (F.col(c) for c in ("doc_id", "source", "text"))
    size, spot, *kept = unused(docs.select(doc_id, source, *[F.col(f"`{c}`") for c in carry]), "size", "spot", *[f"kept_{k}" for k in range(len(carry))])
    key = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    sized = saved(docs.select(doc_id, source, word_count(text).alias(size), key.alias(spot), *[F.col(f"`{c}`").alias(k) for c, k in zip(carry, kept, strict=True)]), "sized")
    sized = sized.withColumnRenamed(size, "size").withColumnRenamed(spot, "spot")
    targets = saved(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit), "targets").withColumnRenamed("source", "of")
    rows = _with_targets(sized, targets)
    shards = F.ceil(F.col("source_size") / SHARD_WORDS)
    rows = rows.withColumn("shard", F.when(F.col("size") > 0, F.conv(F.substring("spot", 1, 8), 16, 10).cast("bigint") % shards))

    # What each shard gives.
    cells = saved(rows.where("size > 0").groupBy("rank", "shard", "source_size", "target").agg(F.sum("size").alias("shard_size")), "shards")
    stopped = F.col("target") >= F.col("source_size") * limit
    blocks = F.ceil(F.col("shard_size") / BLOCK)
    sums = targets.agg(F.sum("source_size").alias("all"), F.sum(F.when(stopped, F.col("source_size"))).alias("stopped")).first()
    rest = (sums["all"] or 0) * float(share) - (sums["stopped"] or 0) * float(limit)
    wanted = cells.where(~stopped).withColumn("wanted", F.col("target") * F.col("shard_size") / F.col("source_size"))
    dealt = apportioned(wanted, int(max(rest, 0.0) / BLOCK + 0.5), rest).drop("wanted")
    given = dealt.unionByName(cells.where(stopped).withColumn("quota", blocks * limit)).withColumn("blocks", blocks)
    given = given.withColumn("quota", F.least("quota", F.col("blocks") * limit)).withColumn("repeats", F.floor(F.col("quota") / F.col("blocks"))).withColumn("extra", F.col("quota") % F.col("blocks"))
    hashed = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda b: _block_hash(F.col("rank"), F.col("shard"), b, seed))
    bar = F.when(F.col("extra") > 0, F.get(F.array_sort(hashed), (F.col("extra") - 1).cast("int")))
    dealt_out = given.repartition(shuffle_partitions(docs), "rank", "shard")  # few and narrow rows, and some 16,000 hashes for each
    given = saved(dealt_out.select("rank", "shard", "repeats", bar.alias("bar")), "given")

    # Where each document lies in its shard, and what of it is taken.
    before = F.sum("size").over(Window.partitionBy("rank", "shard").orderBy("spot").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.where("size > 0").withColumn("start", F.coalesce(before, F.lit(0))).withColumn("stop", F.col("start") + F.col("size"))
    placed = join_checked(placed, given, ["rank", "shard"], "inner")
    touched = F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("stop") - 1) / BLOCK))
    chosen = F.when(F.col("bar").isNotNull(), F.filter(touched, lambda b: _block_hash(F.col("rank"), F.col("shard"), b, seed) <= F.col("bar")))
    first = lambda b: F.greatest(b * BLOCK, F.col("start"))
    pieces = F.transform(chosen, lambda b: F.struct((first(b) - F.col("start")).alias("first"), (F.least((b + 1) * BLOCK, F.col("stop")) - first(b)).alias("words")))
    none = F.expr("cast(array() as array<struct<first: bigint, words: bigint>>)")
    full = placed.withColumn("pieces", F.coalesce(pieces, none)).drop("start", "stop", "bar")
    bare = rows.where("size = 0").withColumn("repeats", F.lit(0).cast("bigint")).withColumn("pieces", none)
    out = full.unionByName(bare)
    taken = F.col("repeats") * F.col("size") + F.aggregate("pieces", F.lit(0).cast("bigint"), lambda s, p: s + p["words"])
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("repeats").cast("int").alias("repeats"), "pieces", taken.alias("taken"), *[F.col(k).alias(c) for c, k in zip(carry, kept, strict=True)])


def _with_targets(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Each document with the rank, size and target of its source; the null source is one like any other."""
    known = targets.withColumn("known", F.coalesce(F.concat(F.lit("s"), F.col("of")), F.lit(""))).drop("of")
    return join_checked(sized.withColumn("known", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))), known, ["known"], "inner").drop("known")


def mixed_texts(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: doc_id, source, text, a row for each pass over a document and for each piece, its words joined by single spaces.

    Takes the settings of :func:`mix` and treats odd rows like it.
    """
    m = mix(docs, carry=("text",), **settings)
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"))
    whole = m.where("repeats > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("repeats"))), F.array_join(words, " ").alias("text")).drop("col")
    parts = m.where("size(pieces) > 0").withColumn("all_words", words).select("doc_id", "source", "all_words", F.explode("pieces").alias("p"))
    return whole.unionByName(parts.select("doc_id", "source", F.array_join(F.slice("all_words", (F.col("p.first") + 1).cast("int"), F.col("p.words").cast("int")), " ").alias("text")))


def mix_counts(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS spot FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM totals),
weighed AS (SELECT *, ([{', '.join(map(str, WEIGHTS))}])[rank % {len(WEIGHTS)} + 1] AS weight FROM ranked),
grand AS (SELECT sum(source_size) * 1.5::DOUBLE AS t, sum(weight) AS w FROM weighed),
stops AS (
  SELECT *, source_size * 2.0::DOUBLE / weight AS stop,
         (t - coalesce(sum(source_size) OVER before, 0) * 2.0::DOUBLE) / (w - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed, grand WINDOW before AS (ORDER BY source_size * 2.0::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, rank, source_size, least(source_size * 2.0::DOUBLE, weight * (SELECT max(level) FROM stops WHERE level <= stop)) AS target FROM stops),
docs AS (
  SELECT d.*, t.rank, t.source_size, t.target, ('0x' || substr(spot, 1, 8))::BIGINT % ceil(t.source_size / {SHARD_WORDS})::BIGINT AS shard
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
cells AS (SELECT rank, shard, source_size, target, sum(size)::BIGINT AS shard_size, ceil(sum(size) / {BLOCK})::BIGINT AS blocks FROM docs WHERE size > 0 GROUP BY ALL),
wanted AS (SELECT rank, shard, target * shard_size / source_size AS wanted FROM cells WHERE target < source_size * 2),
deal AS (
  SELECT floor(((SELECT t FROM grand) - 2.0::DOUBLE * coalesce(sum(source_size) FILTER (WHERE target >= source_size * 2), 0)) / {BLOCK} + 0.5)::BIGINT AS n FROM targets),
quotients AS (
  SELECT rank, shard, j, wanted / (2 * j - 1) AS quotient
  FROM (SELECT *, unnest(range(1, (ceil(wanted / {BLOCK}) * 2 + 3)::BIGINT)) AS j FROM wanted)),
dealt AS (
  SELECT rank, shard, count(*) AS quota
  FROM (SELECT rank, shard, row_number() OVER (ORDER BY quotient DESC, rank, shard, j) AS place FROM quotients), deal WHERE place <= n GROUP BY ALL),
given AS (
  SELECT c.*, CASE WHEN c.target >= c.source_size * 2 THEN 2 * blocks ELSE least(coalesce(quota, 0), 2 * blocks) END AS quota
  FROM cells c LEFT JOIN dealt d ON c.rank = d.rank AND c.shard = d.shard),
hashed AS (
  SELECT rank, shard, quota, blocks, b, row_number() OVER (PARTITION BY rank, shard ORDER BY md5(concat_ws('|', '42', 'block', rank::VARCHAR, shard::VARCHAR, b::VARCHAR))) AS place
  FROM (SELECT *, unnest(range(blocks)) AS b FROM given)),
times AS (SELECT rank, shard, b, quota // blocks + (place <= quota % blocks)::INT AS times FROM hashed),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY rank, shard ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
         row_number() OVER () AS id FROM docs WHERE size > 0),
touched AS (SELECT *, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) AS b FROM placed),
summed AS (
  SELECT id, any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
         sum(times * (least((x.b + 1) * {BLOCK}, start + size) - greatest(x.b * {BLOCK}, start)))::BIGINT AS taken
  FROM touched x JOIN times t ON x.rank = t.rank AND x.shard = t.shard AND x.b = t.b GROUP BY id)
SELECT doc_id, size, source_size, target, taken FROM summed
UNION ALL SELECT doc_id, size, source_size, target, 0::BIGINT FROM docs WHERE size = 0
"""
