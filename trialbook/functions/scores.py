"""Column functions over score arrays and score pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(col: Column) -> Column:
    """NaN becomes NULL, the only missing value used after reading."""
    return F.when(F.isnan(col), F.lit(None)).otherwise(col)


def moments(arr: Column) -> Column:
    """Struct (n, mean, m2) of an array in one pass; m2 is the sum of squared deviations."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(acc: Column, x: Column) -> Column:
        n = acc["n"] + F.lit(1.0)
        step = x - acc["mean"]
        mean = acc["mean"] + step / n
        return F.struct(n.alias("n"), mean.alias("mean"), (acc["m2"] + step * (x - mean)).alias("m2"))

    return F.aggregate(arr, start, add)


def _with(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def array_mean(arr: Column) -> Column:
    """Mean of a score array; NULL when it is empty or missing."""
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(total, F.size(arr))


def array_sample_variance(arr: Column) -> Column:
    """Variance with n-1; NULL below two entries."""
    return _with(moments(arr), lambda m: F.when(m["n"] > 1, m["m2"] / (m["n"] - 1)))


def zscores(arr: Column) -> Column:
    """(x - mean) / population std for each entry; all NULL when the std is 0."""

    def scale(m: Column) -> Column:
        std = F.sqrt(F.try_divide(m["m2"], m["n"]))
        return _with(
            F.struct(m["mean"].alias("mean"), std.alias("std")),
            lambda k: F.transform(arr, lambda x: F.try_divide(x - k["mean"], k["std"])),
        )

    return F.when(arr.isNotNull(), _with(moments(arr), scale))


def coeff_of_variation(arr: Column) -> Column:
    """Population std over mean after shifting every score by abs(min) + 1.

    The shift moves the mean only, so the shifted array is never built.
    """
    shift = F.abs(F.array_min(arr)) + F.lit(1.0)
    return _with(
        moments(arr),
        lambda m: F.try_divide(F.sqrt(F.try_divide(m["m2"], m["n"])), m["mean"] + shift),
    )


def min_max(value: Column, low: Column, high: Column, on_degenerate: str = "null") -> Column:
    """(value - low) / (high - low); an empty range gives NULL or 0."""
    scaled = F.try_divide(value - low, high - low)
    if on_degenerate == "null":
        return F.when(high > low, scaled)
    if on_degenerate == "zero":
        return F.when(value.isNotNull(), F.when(high > low, scaled).otherwise(F.lit(0.0)))
    raise ValueError("on_degenerate is 'null' or 'zero'")


def outcome(better: Column, correct: Column) -> Column:
    return F.when(better, "orange").when(correct, "green").otherwise("blue")


def clip(col: Column, low: Column | float | None, high: Column | float | None) -> Column:
    out = col
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(col.isNotNull(), out)
