"""Distribution tables: ECDF, histogram, density on a grid, box statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialbook.operators.attach import attach
from trialbook.operators.ordering import percentiles_of, ranked_values, value_chunks
from trialbook.session import pin

#: Moments of a cell that a kernel is put together from; a value lies at most a quarter of a
#: bandwidth from its cell's middle, so moment k counts 0.25^k / sqrt(k!) at most.
MOMENTS = 16


def ecdf(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Proportion of values up to each distinct value."""
    ranked = ranked_values(df, by, value)
    share = (F.col("below") + F.col("n")) / F.col("total")
    return ranked.select(*by, value, share.alias("proportion"))


def histogram(df: DataFrame, by: list[str], value: str, bins: int = 30) -> DataFrame:
    """Counts in equal-width bins over the range of each group; the maximum is in the last bin.

    Rows without a group or without a value are in no bin.
    """
    if not by:
        whole = histogram(df.withColumn("_all", F.lit(0)), ["_all"], value, bins)
        return whole.drop("_all")
    known = df.na.drop("any", subset=[*by, value])
    bounds = known.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    joined = attach(known, bounds, by)
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_lo"), width)), F.lit(0))
    binned = joined.withColumn("bin", F.least(place, F.lit(bins - 1)))
    return binned.groupBy(*by, "bin").agg(
        F.min(F.col("_lo") + F.col("bin") * width).alias("bin_start"),
        F.count(F.lit(1)).alias("n"),
    )


def kernel_density(
    df: DataFrame,
    by: list[str],
    value: str,
    grid: int = 200,
    cut: float = 3.0,
    clip: DataFrame | None = None,
) -> DataFrame:
    """Gaussian kernel density on ``grid`` points per group, bandwidth by Scott's rule.

    Values are summed up as ``MOMENTS`` moments in cells of half a bandwidth, one map-side
    aggregate; only these meet the grid points. Within a cell the kernel is its expansion in
    Hermite polynomials; what is left out is below 1e-15 of the kernel's height. ``clip`` gives
    optional ``clip_lo`` / ``clip_hi`` per group.
    """
    known = df.filter(F.col(value).isNotNull())
    stats = (
        known.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.stddev_samp(value).alias("_sd"),
            F.min(value).alias("_min"),
            F.max(value).alias("_max"),
        )
        .withColumn("_h", F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2)))
        .filter(F.col("_h") > 0)
    )
    lo, hi = F.col("_min") - cut * F.col("_h"), F.col("_max") + cut * F.col("_h")
    if clip is not None:
        stats = stats.join(clip, by, "left")
        lo = F.greatest(lo, F.coalesce(F.col("clip_lo"), lo))
        hi = F.least(hi, F.coalesce(F.col("clip_hi"), hi))
    stats = pin(stats.select(*by, "_n", "_h", "_min", lo.alias("_lo"), ((hi - lo) / (grid - 1)).alias("_step")))
    # places in bandwidths above the least value; each cell is a quarter wide to either side
    place = (F.col(value) - F.col("_min")) / F.col("_h")
    placed = attach(known.select(*by, value), stats.select(*by, "_h", "_min"), by, how="inner").select(*by, place.alias("_u"))
    placed = placed.select(*by, "_u", F.floor(F.col("_u") * 2).alias("_cell"))
    off = F.col("_u") - (F.col("_cell") + 0.5) / 2
    powers = [F.sum(F.pow(off, F.lit(k))) / math.factorial(k) for k in range(MOMENTS)]
    cells = placed.groupBy(*by, "_cell").agg(F.array(*powers).alias("_m"))
    points = attach(cells, stats, by, how="inner").select("*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"))
    x = F.col("_lo") + F.col("i") * F.col("_step")
    points = points.withColumns({"_x": x, "_y": (x - F.col("_min")) / F.col("_h") - (F.col("_cell") + 0.5) / 2})
    # the sum of moment k times polynomial k, which follows from the two before it
    none = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), F.lit(0.0).alias("k"))

    def add(so_far, moment):
        following = F.col("_y") * so_far["b"] - so_far["k"] * so_far["a"]
        return F.struct(
            (so_far["s"] + moment * so_far["b"]).alias("s"), so_far["b"].alias("a"), following.alias("b"), (so_far["k"] + 1).alias("k")
        )

    kernel = F.aggregate("_m", none, add, lambda r: r["s"]) * F.exp(F.lit(-0.5) * F.col("_y") * F.col("_y"))
    scale = F.max("_n") * F.max("_h") * math.sqrt(2.0 * math.pi)
    return points.groupBy(*by, "i").agg(
        F.max("_x").alias("x"), (F.sum(kernel) / scale).alias("density")
    )


def box_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles, whiskers within 1.5 IQR of the box, and the notch of the median."""
    values = value_chunks(df, by, value)
    quarts = percentiles_of(values, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    whiskers = (
        attach(values.select(*by, value), quarts, by, how="inner")
        .groupBy(*by)
        .agg(
            F.min(F.when(F.col(value) >= low, F.col(value))).alias("whisker_lo"),
            F.max(F.when(F.col(value) <= high, F.col(value))).alias("whisker_hi"),
        )
    )
    reach = F.lit(1.57) * iqr / F.sqrt(F.col("n"))
    return quarts.join(whiskers, by).select(
        *by,
        "n",
        "q1",
        "median",
        "q3",
        # where no value lies between the box and the fence, the whisker ends at the box
        F.least("whisker_lo", "q1").alias("whisker_lo"),
        F.greatest("whisker_hi", "q3").alias("whisker_hi"),
        (F.col("median") - reach).alias("notch_lo"),
        (F.col("median") + reach).alias("notch_hi"),
    )
