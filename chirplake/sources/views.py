"""Views that let the operators run on the driver's tables: pool, events, samples, series and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chirplake.config import DEFAULT, GLOBAL_CLASSES, SNR_BINS, SNR_WEIGHTS
from chirplake.functions import draws
from chirplake.functions import scalars as S
from chirplake.operators.ranks import quota_sizes, rank_cuts, within_cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pool(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Transient catalog: ord, ifo, gps, label, snr, further columns of events, grp (source group), fid (file number)."""
    return as_pool(table(spark, sf_dir, "events"), *more)


def as_pool(e: DataFrame, *more: Column) -> DataFrame:
    gps = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    rows = e.select(F.col("event_id").alias("ord"), F.when(F.col("user_id") % 2 == 0, "H1").otherwise("L1").alias("ifo"), gps.alias("gps"), F.col("event_type").alias("label"), F.col("value").alias("snr"), *more)
    return rows.withColumn("grp", S.source_group(F.col("ifo"), F.col("gps"))).withColumn("fid", F.floor(F.col("gps") / 4096).cast("bigint"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """num (order key), global_class and what follows from it."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("num"))
    o = o.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "num")  # keys alone, and many to a byte: a file may be one task, and little for its work
    klass = F.element_at(F.array(*map(F.lit, GLOBAL_CLASSES)), (F.col("num") % 6 + 1).cast("int"))
    rows = o.withColumn("global_class", klass)
    chirp = ~F.col("global_class").isin("glitch_only", "pure_noise")
    return rows.select("num", "global_class", S.signal_type(F.col("global_class")).alias("signal_type"), chirp.cast("int").alias("has_chirp"), F.col("global_class").contains("glitch").cast("int").alias("has_glitch"))


def with_split(events: DataFrame, ratios: dict[str, float] | None = None) -> DataFrame:
    """Exact split sizes by largest remainder, dealt over the events in the order of a hash; ``num`` is their key."""
    names = list(ratios := ratios or DEFAULT.ratios)
    digest, num = draws.rank_hash("split", F.col("num")), F.col("num")
    upto = lambda sizes, k: F.aggregate(F.slice(sizes, 1, k), F.lit(0).cast("bigint"), lambda s, p: s + p["size"])
    sizes = quota_sizes(F.col("__total"), ratios)
    cuts = rank_cuts(events, digest, num, F.array(*[upto(sizes, k) for k in range(1, len(names))]).cast("array<bigint>"), "__cuts")
    rows = events.crossJoin(F.broadcast(cuts)).withColumn("__digest", digest)
    out = F.lit(names[-1])
    for k, name in reversed(list(enumerate(names[:-1]))):
        out = F.when(within_cut(F.col("__digest"), num, F.col("__cuts")[k]), name).otherwise(out)
    return rows.withColumn("split", out).drop("__cuts", "__digest")


def bin_edges(kind: Column, name: Column, end: int) -> Column:
    """An edge of a bin, looked up: as conditions the edges alone made Spark's generated method longer than what the JVM compiles (8,000 bytes)."""
    edges = {f"{signal} {bin_name}": bounds[end] for signal, bins in SNR_BINS.items() for bin_name, bounds in bins.items()}
    return F.create_map(*[F.lit(x) for pair in edges.items() for x in pair])[F.concat(kind, F.lit(" "), name)]


def six_digits(num: Column) -> Column:
    """``%06d``; the format itself, which costs several draws, only for null and negative numbers."""
    digits = num.cast("string")
    return F.when(num >= 1_000_000, digits).when(num >= 0, F.lpad(digits, 6, "0")).otherwise(F.format_string("%06d", num))


def astro_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event with its split and drawn parameters."""
    n = F.col("num")
    e = with_split(raw_events(spark, sf_dir))
    chirp = F.col("has_chirp") == 1
    e = e.withColumn("event_id", F.concat(F.lit("evt_"), six_digits(n))).withColumn("chirp_id", F.when(chirp, F.concat(F.lit("chirp_"), six_digits(n))))
    e = e.withColumn("snr_bin", F.when(chirp, draws.weighted(draws.u("snr_bin", n), SNR_WEIGHTS)))
    low, high = (bin_edges(F.col("signal_type"), F.col("snr_bin"), k) for k in (0, 1))
    e = e.withColumn("target_snr", F.when(chirp, low + draws.u("snr", n) * (high - low)))
    e = e.withColumn("event_time", 1.0 + draws.u("time", n) * 2.0)
    e = e.withColumn("label_low", F.when(chirp, 20.0 + draws.u("flo", n) * 60.0))
    return e.withColumn("label_high", F.when(chirp, F.col("label_low") + 40.0 + draws.u("fhi", n) * 260.0))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event and detector."""
    return detected(astro_events(spark, sf_dir))


def detected(e: DataFrame) -> DataFrame:
    """One row per event and detector, of a table of events as :func:`astro_events` gives it (without target_snr there is no detector_snr)."""
    s = e.withColumn("d", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("detector", F.when(F.col("d") == 0, "H1").otherwise("L1"))
    n, d = F.col("num"), F.col("detector")
    chirp, glitch = F.col("has_chirp") == 1, F.col("has_glitch") == 1
    pick = F.floor(draws.u("glitch", n, d) * 4000).cast("bigint")
    delay = (draws.u("delay", n, d) * 2.0 - 1.0) * 0.01
    jitter = 1.0 + (draws.u("snr_jitter", n, d) * 2.0 - 1.0) * 0.15
    real = draws.u("noise", n, d) < 0.5
    s = s.withColumn("ord", n * 2 + F.col("d")).withColumn("sample_id", F.concat_ws("_", "split", six_digits(n), d))
    s = s.withColumn("time_delay", F.when(chirp, delay)).withColumn("injection_time", F.when(chirp, F.col("event_time") + delay))
    if "target_snr" in e.columns:
        s = s.withColumn("detector_snr", F.when(chirp, F.col("target_snr") * jitter))
    s = s.withColumn("noise_id", F.format_string("noise_%08d", "ord")).withColumn("noise_type", F.when(real, "real_gwosc_offsource").otherwise("gaussian_aligo_colored"))
    s = s.withColumn("background_source", F.lit(None).cast("string"))
    s = s.withColumn("background_source_group", F.when(real, F.concat_ws(":", d, F.floor(draws.u("background", n, d) * 5000).cast("bigint").cast("string"))))
    s = s.withColumn("glitch_id", F.when(glitch, F.format_string("glitch_%08d", pick)))
    s = s.withColumn("glitch_gps", F.when(glitch, 1260000000.0 + pick * 997.0))
    s = s.withColumn("glitch_type", F.when(glitch, draws.choice("glitch_type", ("Blip", "Tomte", "Whistle"), pick)))
    explicit = glitch & (pick % 3 == 0)
    return s.withColumn("glitch_source_group", F.when(explicit, S.source_group(d, F.col("glitch_gps")))).drop("d")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x: array<double> of 64 samples in one second."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("label"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, i, r, c, energy: each series as an 8 x 8 grid of squares, high frequencies first."""
    s = series(spark, sf_dir).select("id", F.posexplode("x").alias("i", "v"))
    return s.select("id", F.col("i").cast("bigint").alias("i"), F.floor(F.col("i") / 8).cast("bigint").alias("r"), (F.col("i") % 8).cast("bigint").alias("c"), (F.col("v") * F.col("v")).alias("energy"))
