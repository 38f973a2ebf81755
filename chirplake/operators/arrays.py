"""Robust statistics, energy normalisation and ridge boxes over array columns, in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def robust(cells: DataFrame, by: str, value: str) -> DataFrame:
    """Exact median, MAD, robust sigma (population deviation where the MAD is zero), P99.5, maximum and mean per key.

    For many keys of bounded size; one group-wise sort each, no samples.
    """
    med = cells.groupBy(by).agg(F.percentile(value, 0.5).alias("median"))
    dev = cells.join(med, by).withColumn("dev", F.abs(F.col(value) - F.col("median")))
    out = dev.groupBy(by).agg(
        F.first("median").alias("median"), F.percentile("dev", 0.5).alias("mad"), F.stddev_pop(value).alias("std"),
        F.percentile(value, 0.995).alias("p995"), F.max(value).alias("peak"), F.avg(value).alias("mean"), F.count("*").alias("n"),
    )
    return out.withColumn("sigma", F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).otherwise(F.col("std")))


def quantile(sorted_values: Column, q: float) -> Column:
    """Linear interpolation within a sorted array."""
    place = (F.size(sorted_values) - 1) * F.lit(q)
    low = F.floor(place).cast("int")
    a, b = F.get(sorted_values, low), F.get(sorted_values, F.least(low + 1, F.size(sorted_values) - 1))
    return a + (b - a) * (place - low)



def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``, even where that puts it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def percentile_normalized(x: Column, vmax: float = 25.0, percentile: float = 99.5) -> Column:
    """Values over their percentile (their maximum, or 1, if that is not positive), times vmax; not yet clipped."""
    reference = let(F.array_sort(x), lambda s: quantile(s, percentile / 100))
    top = F.array_max(x)
    return let(F.when(reference > 0, reference).when(top != 0, top).otherwise(1.0), lambda r: F.transform(x, lambda v: v / r * vmax))


def mad_normalized(x: Column, vmax: float = 25.0) -> Column:
    """Robust z-scores, negative ones as zero, six of which are vmax; not yet clipped."""
    median = let(F.array_sort(x), lambda s: quantile(s, 0.5))

    def scaled(m: Column) -> Column:
        mad = let(F.array_sort(F.transform(x, lambda v: F.abs(v - m))), lambda s: quantile(s, 0.5))
        mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
        std = let(mean, lambda a: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - a) * (v - a)) / F.size(x)))
        sigma = F.when(mad > 0, 1.4826 * mad).otherwise(std + 1e-12)
        return let(sigma, lambda d: F.transform(x, lambda v: F.greatest((v - m) / d, F.lit(0.0)) / 6.0 * vmax))

    return let(median, scaled)


def normalized(rows: DataFrame, column: str, method: str = "percentile", vmin: float = 0.0, vmax: float = 25.0, percentile: float = 99.5) -> DataFrame:
    """Add energy (clipped to [vmin, vmax]) and energy_peak, the maximum before clipping; an empty array has none."""
    if method not in ("percentile", "mad"):
        raise ValueError("method must be 'percentile' or 'mad'")
    scaled = percentile_normalized(F.col(column), vmax, percentile) if method == "percentile" else mad_normalized(F.col(column), vmax)
    clip = lambda v: F.least(F.greatest(v, F.lit(vmin)), F.lit(vmax))
    both = let(scaled, lambda s: F.struct(F.transform(s, clip).alias("energy"), F.array_max(s).alias("peak")))
    out = rows.withColumn("__scaled", both)
    return out.withColumn("energy", F.col("__scaled.energy")).withColumn("energy_peak", F.col("__scaled.peak")).drop("__scaled")


def loud_pixels(x: Column, threshold: float) -> Column:
    return F.size(F.filter(x, lambda v: v >= threshold))


def l2_norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))


def usable_segment(x: Column, length: int) -> Column:
    """Full length, all finite and not all zero."""
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(x) == length) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def zeroed(x: Column) -> Column:
    """Missing, undefined and infinite samples as zeros."""
    return F.transform(x, lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v))


def segment(x: Column, start: Column, length: int) -> Column:
    """``length`` samples from ``start`` (from 0)."""
    return F.slice(x, start.cast("int") + 1, length)


def pedestal_ratio(cells: DataFrame, by: str, inside: Column) -> DataFrame:
    """Mean energy inside a window over that outside; null where either is missing or zero outside."""
    means = cells.groupBy(by).agg(F.avg(F.when(inside, F.col("energy"))).alias("mean_in"), F.avg(F.when(~inside, F.col("energy"))).alias("mean_out"))
    return means.withColumn("ratio", F.col("mean_in") / F.nullif(F.col("mean_out"), F.lit(0.0)))


def ridge_bounds(cells: DataFrame, by: str, ridge: float = 0.3) -> DataFrame:
    """Outermost rows and columns of the cells at ``ridge`` of the peak or more: r_min, r_max, c_min, c_max per key with a positive peak."""
    peak = cells.groupBy(by).agg(F.max("energy").alias("peak")).where("peak > 0")
    hot = cells.join(peak, by).where(F.col("energy") >= F.col("peak") * ridge)
    return hot.groupBy(by).agg(F.min("r").alias("r_min"), F.max("r").alias("r_max"), F.min("c").alias("c_min"), F.max("c").alias("c_max"), F.count("*").alias("hot"))


def mass_bounds(cells: DataFrame, by: str, ridge: float = 0.3, gate: float = 5.0, q: float = 0.01) -> DataFrame:
    """Rows and columns between which all but ``q`` of the hot energy lies on either side.

    Hot is what reaches both the ridge and ``gate`` times the median, so noise
    does not count, and a faint far pixel does not stretch the bounds.
    """
    limits = cells.groupBy(by).agg(F.greatest(F.max("energy") * ridge, F.percentile("energy", 0.5) * gate).alias("limit"), F.max("energy").alias("peak")).where("peak > 0")
    hot = cells.join(limits, by).where(F.col("energy") >= F.col("limit"))
    out: DataFrame | None = None
    for axis in ("r", "c"):
        profile = hot.groupBy(by, axis).agg(F.sum("energy").alias("mass"))
        run = F.sum("mass").over(Window.partitionBy(by).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0))
        total = F.sum("mass").over(Window.partitionBy(by))
        # Rounded, so that the last step of a running sum cannot fall short of the total.
        marked = profile.select(by, axis, F.round(run, 12).alias("cum"), F.round(total, 12).alias("total"))
        both = marked.groupBy(by).agg(
            F.min(F.when(F.col("cum") >= F.round(F.col("total") * q, 12), F.col(axis))).alias(f"{axis}_low"),
            F.coalesce(F.min(F.when(F.col("cum") >= F.round(F.col("total") * (1 - q), 12), F.col(axis))), F.max(axis)).alias(f"{axis}_high"),
        )
        out = both if out is None else out.join(both, by)
    assert out is not None
    return out


def box_mismatch(meta: Column, labels: Column, tolerance: float = 0.01) -> Column:
    """Whether the nearest label box (largest difference of cx, cy, w, h) is further than the tolerance, or there is none."""
    gap = lambda box: F.array_max(F.array(*[F.abs(box[k] - meta[k]) for k in ("cx", "cy", "w", "h")]))
    nearest = F.array_min(F.transform(labels, gap))
    return F.when(meta.isNotNull(), F.coalesce(nearest > tolerance, F.lit(True)))


def dft_power(series: DataFrame, by: str, column: str) -> DataFrame:
    """Power of each frequency by the direct transform: by, k, power (for short series; FFT kernels are in ``spectral``)."""
    n = F.size(column)
    angle = lambda k, i: F.lit(-2.0) * F.pi() * ((k * i) % n) / n
    part = lambda f: lambda k: F.aggregate(F.transform(column, lambda v, i: v * f(angle(k, i))), F.lit(0.0), lambda s, v: s + v)
    spread = series.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(n / 2).cast("int"))))
    re, im = part(F.cos)(F.col("k")), part(F.sin)(F.col("k"))
    return spread.select(by, F.col("k").cast("bigint").alias("k"), (re * re + im * im).alias("power"))
