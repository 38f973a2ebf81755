"""Counter-based random draws: a function of seed, salt and key, and of nothing else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chirplake.config import DEFAULT


def draw_key(salt: str, *keys: Column, seed: int = DEFAULT.seed) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[k.cast("string") for k in keys])


def u(salt: str, *keys: Column, seed: int = DEFAULT.seed) -> Column:
    """Uniform in [0, 1), in steps of 2**-32."""
    return F.conv(F.substring(F.md5(draw_key(salt, *keys, seed=seed)), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def rank_hash(salt: str, *keys: Column, seed: int = DEFAULT.seed) -> Column:
    """A hash to order by where rows are to be shuffled."""
    return F.md5(draw_key(salt, *keys, seed=seed))


def uniform(salt: str, low: float | Column, high: float | Column, *keys: Column) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return low + u(salt, *keys) * (high - low)


def choice(salt: str, values: tuple[str, ...], *keys: Column) -> Column:
    """One of the values, each as likely."""
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u(salt, *keys) * len(values)) + 1).cast("int"))


def weighted(draw: Column, weights: dict[str, float]) -> Column:
    """The name in whose share of [0, 1) the draw falls; the last takes what rounding leaves."""
    names, total, out = list(weights), 0.0, None
    for name in names[:-1]:
        total = round(total + weights[name], 9)
        out = F.when(draw < total, name) if out is None else out.when(draw < total, name)
    return F.lit(names[0]) if out is None else out.otherwise(names[-1])
