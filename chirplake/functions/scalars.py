"""Scalar column functions. Missing values are nulls; all of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chirplake.config import BACKGROUND_DOMAINS, DEFAULT, FILE_SECONDS, FREQ_HIGH, FREQ_LOW, TRUTHY

#: A decimal number as strict readers take it, blanks around it allowed.
NUMBER = r"^\s*[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"


def _c(x: Column | float | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def strict_double(text: Column) -> Column:
    """A number or null: no trailing letters, digits may be grouped by underscores; inf and nan by name."""
    trimmed = F.lower(F.trim(text))
    named = F.when(trimmed.rlike(r"^[+-]?(inf|infinity)$"), F.when(trimmed.startswith("-"), float("-inf")).otherwise(float("inf"))).when(trimmed.rlike(r"^[+-]?nan$"), float("nan"))
    return F.when(text.rlike(NUMBER), F.regexp_replace(F.trim(text), "_", "").try_cast("double")).otherwise(named)


def nonzero(x: Column) -> Column:
    """Zero counts as missing."""
    return F.nullif(x, F.lit(0.0))


def truthy(x: Column) -> Column:
    return F.coalesce(F.trim(x.cast("string")).isin(*TRUTHY), F.lit(False))


def source_group(ifo: Column, gps: Column) -> Column:
    return F.concat_ws(":", ifo, F.floor(gps / F.lit(FILE_SECONDS)).cast("bigint").cast("string"))


def glitch_group(explicit: Column, detector: Column, gps: Column) -> Column:
    """The stated group, else the one of detector and time; null without either."""
    derived = F.when(gps.isNotNull(), source_group(F.coalesce(detector, F.lit("")), gps))
    return F.coalesce(F.nullif(explicit, F.lit("")), derived)


def background_domain(explicit: Column, noise_type: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in BACKGROUND_DOMAINS.items() for x in pair])
    noise = F.nullif(noise_type, F.lit(""))
    return F.coalesce(F.nullif(explicit, F.lit("")), known[noise], noise)


def signal_type(global_class: Column) -> Column:
    return F.when(global_class.startswith("bbh"), "BBH").when(global_class.startswith("bns"), "BNS").otherwise("None")


def freq_to_unit(f: Column, low: float = FREQ_LOW, high: float = FREQ_HIGH, scale: str = "log") -> Column:
    """Place on the frequency axis, clipped to [0, 1]."""
    if scale == "log":
        place = (F.log(F.greatest(f, F.lit(1e-9))) - F.log(F.lit(low))) / (F.log(F.lit(high)) - F.log(F.lit(low)))
    else:
        place = (f - low) / (high - low)
    return F.when(f.isNotNull(), F.least(F.greatest(place, F.lit(0.0)), F.lit(1.0)))


def unit_to_freq(unit: Column, low: float = FREQ_LOW, high: float = FREQ_HIGH, scale: str = "log") -> Column:
    if scale == "log":
        return F.exp(F.log(F.lit(low)) + unit * (F.log(F.lit(high)) - F.log(F.lit(low))))
    return low + unit * (high - low)


def row_frequencies(height: int | Column, low: float = FREQ_LOW, high: float = FREQ_HIGH, scale: str = "log") -> Column:
    """Frequency of each image row, the highest first."""
    h = _c(height).cast("int")
    return F.transform(F.sequence(F.lit(0), h - 1), lambda r: unit_to_freq(1 - r / F.greatest(h - 1, F.lit(1)), low, high, scale))


def edges(centres: Column) -> Column:
    """Bin edges halfway between centres; the outer ones as far out as the first and last halves. One centre: half a unit to each side."""
    n = F.size(centres)
    at = lambda k: F.get(centres, k)
    inner = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: (at(k - 1) + at(k)) / 2)
    first = at(F.lit(0)) - (at(F.lit(1)) - at(F.lit(0))) / 2
    last = at(n - 1) + (at(n - 1) - at(n - 2)) / 2
    return F.when(n == 1, F.array(at(F.lit(0)) - 0.5, at(F.lit(0)) + 0.5)).when(n > 1, F.concat(F.array(first), inner, F.array(last)))


def freq_overlap(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Intersection over union of two ranges; zero when a bound is missing or the union is empty."""
    whole = a_low.isNotNull() & a_high.isNotNull() & b_low.isNotNull() & b_high.isNotNull()
    inter = F.greatest(F.lit(0.0), F.least(a_high, b_high) - F.greatest(a_low, b_low))
    union = F.greatest(a_high, b_high) - F.least(a_low, b_low)
    return F.when(whole & (union > 0), inter / union).otherwise(F.lit(0.0))


def delay_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def valid_delay(difference: Column, limit: float = DEFAULT.max_physical_delay) -> Column:
    return F.coalesce((difference <= limit) & ~F.isnan(difference), F.lit(False)).cast("int")


def same_chirp(a: Column, b: Column) -> Column:
    return F.coalesce((a == b) & (a != ""), F.lit(False)).cast("int")


def chirp_mass(m1: Column, m2: Column) -> Column:
    return F.pow(m1 * m2, 0.6) / F.pow(m1 + m2, 0.2)


def mass_ratio(m1: Column, m2: Column) -> Column:
    return F.least(m1, m2) / F.greatest(m1, m2)


def chi_eff(m1: Column, m2: Column, s1: Column, s2: Column) -> Column:
    return (m1 * s1 + m2 * s2) / (m1 + m2)


def clipped_box(t0: Column, t1: Column, low: Column, high: Column, class_id: int, source: str, duration: float = DEFAULT.duration, clip_both: bool = True) -> Column:
    """A box within the picture, or null if nothing of it is. Chirp boxes clip both frequency edges to the window, glitch boxes one each."""
    inside = lambda t: F.greatest(F.lit(0.0), F.least(t, F.lit(duration)))
    window = lambda f: F.greatest(F.lit(FREQ_LOW), F.least(f, F.lit(FREQ_HIGH)))
    a, b = inside(t0), inside(t1)
    lo, hi = (window(low), window(high)) if clip_both else (F.greatest(F.lit(FREQ_LOW), low), F.least(F.lit(FREQ_HIGH), high))
    box = F.struct(a.alias("time_start"), b.alias("time_end"), lo.alias("freq_low"), hi.alias("freq_high"), F.lit(class_id).alias("class_id"), F.lit(source).alias("source"))
    known = t0.isNotNull() & t1.isNotNull() & low.isNotNull() & high.isNotNull()
    return F.when(known & (b > a) & (hi > lo), box)


def chirp_box(t0: Column, t1: Column, low: Column, high: Column, source: str = "waveform_instfreq", duration: float = DEFAULT.duration) -> Column:
    return clipped_box(t0, t1, low, high, 0, source, duration)


def glitch_box(t0: Column, t1: Column, low: Column, high: Column, duration: float = DEFAULT.duration) -> Column:
    return clipped_box(t0, t1, low, high, 1, "glitch_synthetic", duration, clip_both=False)


def box_area(box: Column, duration: float = DEFAULT.duration, scale: str = "log") -> Column:
    height = freq_to_unit(box["freq_high"], scale=scale) - freq_to_unit(box["freq_low"], scale=scale)
    return F.greatest(F.lit(0.0), box["time_end"] - box["time_start"]) / duration * F.greatest(F.lit(0.0), height)


def yolo(box: Column, duration: float = DEFAULT.duration, low: float = FREQ_LOW, high: float = FREQ_HIGH, scale: str = "log") -> Column:
    """class_id, cx, cy, w, h as shares of the picture, whose top is the highest frequency."""
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    a, b = freq_to_unit(box["freq_low"], low, high, scale), freq_to_unit(box["freq_high"], low, high, scale)
    return F.when(
        box.isNotNull(),
        F.struct(
            box["class_id"].alias("class_id"),
            clip((box["time_start"] + box["time_end"]) / 2 / duration).alias("cx"),
            clip(1 - (a + b) / 2).alias("cy"),
            clip((box["time_end"] - box["time_start"]) / duration).alias("w"),
            clip(F.abs(b - a)).alias("h"),
        ),
    )


def yolo_line(y: Column) -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", y["class_id"], *[F.bround(y[k], 6) for k in ("cx", "cy", "w", "h")])


def parse_yolo(line: Column, lenient: bool = False) -> Column:
    """Box of a label line with five tokens, else null; a lenient class may be written as a decimal."""
    parts = F.split(F.trim(line), r"\s+")
    number = strict_double(F.get(parts, F.lit(0)))
    strict = F.get(parts, F.lit(0)).rlike(r"^[+-]?\d+$")
    values = [strict_double(F.get(parts, F.lit(k))) for k in range(1, 5)]
    good = (F.size(parts) == 5) & number.isNotNull() & (F.lit(True) if lenient else strict)
    for v in values:
        good = good & v.isNotNull()
    return F.when(good, F.struct(number.cast("int").alias("class_id"), *[v.alias(k) for v, k in zip(values, ("cx", "cy", "w", "h"), strict=True)]))


def metadata_box(has_chirp: Column, cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """The chirp box that a metadata row states, or null unless it has a chirp and all four numbers."""
    known = has_chirp.cast("string").eqNullSafe(F.lit("1")) & cx.isNotNull() & cy.isNotNull() & w.isNotNull() & h.isNotNull()
    return F.when(known, F.struct(F.lit(0).alias("class_id"), cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h")))


def pixel_rectangle(y: Column, width: int, height: int) -> Column:
    """Corners of a box in pixels."""
    x, yy, w, h = y["cx"] * width, y["cy"] * height, y["w"] * width, y["h"] * height
    return F.struct((x - w / 2).alias("left"), (yy - h / 2).alias("top"), (x + w / 2).alias("right"), (yy + h / 2).alias("bottom"))


def isco_frequency(total_mass: Column) -> Column:
    """Frequency of the last stable orbit for a mass in suns."""
    return F.lit(299792458.0**3) / (F.lit(6**1.5 * 3.141592653589793 * 6.6743e-11 * 1.98847e30) * total_mass)


def gps_key(detector: Column, gps: Column) -> Column:
    """detector:gps to four places, as the blacklist and cache name segments; halves of the product go up, as in DuckDB's round."""
    return F.concat_ws(":", detector, F.format_string("%.4f", F.round(gps * 10000.0) / 10000.0))


def fmt6(x: Column) -> Column:
    """Text of a number for CSV: six places, empty if missing or not finite."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, "").otherwise(F.format_string("%.6f", F.bround(x.cast("double"), 6)))
