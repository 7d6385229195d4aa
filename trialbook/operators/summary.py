"""Grouped summaries with their total rows.

The means, counts and extremes are plain aggregates with map-side partial results.
``total`` rows come from ``rollup`` over few groups: the groups are aggregated first and
only their partial sums are rolled up, so the rows are not doubled by the rollup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialbook.functions.scores import array_sample_variance, min_max
from trialbook.operators.attach import attach
from trialbook.operators.ordering import percentiles
from trialbook.session import pin


def _with_total(parts: DataFrame, keys: list[str], by: str, outputs: dict[str, Column], label: str):
    """Merge partial sums per (keys, by) into rows per group and one total row per ``keys``."""
    own = parts.filter(F.col(by).isNotNull()).groupBy(*keys, by).agg(
        *[c.alias(n) for n, c in outputs.items()]
    )
    total = parts.groupBy(*keys).agg(*[c.alias(n) for n, c in outputs.items()])
    return own.unionByName(total.withColumn(by, F.lit(label)))


def means_with_total(
    df: DataFrame, by: str, values: dict[str, Column], keys: list[str] | None = None,
    label: str = "Overall",
) -> DataFrame:
    """Mean of each value per group, and over all rows (rows without a group key included)."""
    keys = keys or []
    sums = [F.sum(c).alias(f"_s_{n}") for n, c in values.items()]
    counts = [F.count(c).alias(f"_n_{n}") for n, c in values.items()]
    parts = df.groupBy(*keys, by).agg(*sums, *counts)
    outputs = {n: F.try_divide(F.sum(f"_s_{n}"), F.sum(f"_n_{n}")) for n in values}
    return _with_total(parts, keys, by, outputs, label)


def mean_with_total(df: DataFrame, by: str, value: str, label: str = "Overall", **kw) -> DataFrame:
    return means_with_total(df, by, {value: F.col(value)}, label=label, **kw)


def missing_fraction(df: DataFrame, by: str, value: str, label: str = "Overall") -> DataFrame:
    flag = F.col(value).isNull().cast("double")
    return means_with_total(df, by, {"nan_fraction": flag}, label=label)


def outcome_rates(df: DataFrame, by: str, flags: dict[str, str], label: str = "Overall") -> DataFrame:
    """Percentage of rows with each flag set."""
    values = {n: F.col(c).cast("double") * 100 for n, c in flags.items()}
    return means_with_total(df, by, values, label=label)


def scaled_group_means(df: DataFrame, dataset: str, by: str, value: str) -> DataFrame:
    """Mean per (dataset, group), scaled by the range of the group's means over all datasets."""
    means = (
        df.filter(F.col(by).isNotNull())
        .groupBy(dataset, by)
        .agg(F.avg(value).alias("mean_score"))
    )
    bounds = group_mean_bounds(means, by)
    scaled = min_max(F.col("mean_score"), F.col("min_mean"), F.col("max_mean"), "zero")
    return attach(means, bounds, [by]).withColumn("scaled_score", scaled).drop(
        "min_mean", "max_mean"
    )


def group_mean_bounds(means: DataFrame, by: str) -> DataFrame:
    return means.groupBy(by).agg(
        F.min("mean_score").alias("min_mean"), F.max("mean_score").alias("max_mean")
    )


def scaled_overall(
    df: DataFrame, dataset: str, by: str, value: str, label: str = "Overall"
) -> DataFrame:
    """Scaled group means per dataset and their mean as the total row."""
    scaled = scaled_group_means(df, dataset, by, value).select(dataset, by, "scaled_score")
    total = scaled.groupBy(dataset).agg(F.avg("scaled_score").alias("scaled_score"))
    return scaled.unionByName(total.withColumn(by, F.lit(label)))


def median_overall(
    df: DataFrame, dataset: str, by: str, value: str, label: str = "Overall"
) -> DataFrame:
    """Median per (dataset, group) and the median of these medians per dataset."""
    own = percentiles(
        df.filter(F.col(by).isNotNull()), [dataset, by], value, {"median_score": 0.5}
    ).drop("n")
    # one row per group is left here, so the plain median has little to hold
    total = own.groupBy(dataset).agg(F.median("median_score").alias("median_score"))
    return own.unionByName(total.withColumn(by, F.lit(label)))


def multi_stats(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """min, max, mean and median of several columns, one row per group and column."""
    long = pin(df.select(*by, *values)).unpivot(by, values, "metric", "score")
    simple = long.groupBy(*by, "metric").agg(
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        F.avg("score").alias("mean_score"),
    )
    medians = percentiles(long, [*by, "metric"], "score", {"median_score": 0.5}).drop("n")
    return simple.join(medians, [*by, "metric"], "left")


def describe_by(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, mean, sample std, min, quartiles and max per group."""
    df = pin(df.select(*by, value))  # read twice
    simple = df.groupBy(*by).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    quartiles = percentiles(df, by, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}).drop("n")
    return simple.join(quartiles, by, "left")


def completeness(df: DataFrame, by: str, value: str) -> DataFrame:
    """Rows, rows with a value, and their ratio per group."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(value).alias("n_present"),
        (F.count(value) / F.count(F.lit(1))).alias("ratio"),
    )


def cleaning_ratio(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Rows before and after dropping incomplete rows, and the kept share."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_before"),
        F.count(F.when(whole, 1)).alias("n_after"),
        (F.count(F.when(whole, 1)) / F.count(F.lit(1))).alias("ratio"),
    )


def scaled_variance(
    df: DataFrame, dataset: str, by: str, scores: str, average: str, label: str = "Overall"
) -> DataFrame:
    """Mean within-row variance of the scaled score arrays per (dataset, group), with totals.

    An array shorter than two counts as 0, as does one whose group has no range. Scaling
    divides a variance by the squared range of its group, so the rows are summed once,
    unscaled, and only the sums are scaled.
    """
    row = F.coalesce(array_sample_variance(F.col(scores)), F.lit(0.0))
    sums = df.groupBy(dataset, by).agg(
        F.sum(row).alias("_var"), F.count(F.lit(1)).alias("_n"), F.avg(average).alias("mean_score")
    )
    bounds = group_mean_bounds(sums.filter(F.col(by).isNotNull()), by)
    span = F.col("max_mean") - F.col("min_mean")
    scaled = attach(sums, bounds, [by]).withColumn(
        "_var", F.when(span > 0, F.try_divide(F.col("_var"), span * span)).otherwise(F.lit(0.0))
    )
    outputs = {"average_variance": F.sum("_var") / F.sum("_n")}
    return _with_total(scaled, [dataset], by, outputs, label)


def relative_means(df: DataFrame, by: str, value: str, label: str = "Overall") -> DataFrame:
    """Mean of the min-max scaled value per group and over all rows, in one pass.

    The mean of scaled values is the scaled mean, so no row is scaled. Groups without a
    range have no scaled values and do not count in the total.
    """
    parts = df.filter(F.col(by).isNotNull()).groupBy(by).agg(
        F.sum(value).alias("_s"), F.count(value).alias("_n"),
        F.min(value).alias("_lo"), F.max(value).alias("_hi"),
    )
    ranged = parts.withColumn("_n", F.when(F.col("_hi") > F.col("_lo"), F.col("_n")))
    mean = min_max(F.try_divide(F.col("_s"), F.col("_n")), F.col("_lo"), F.col("_hi"))
    scaled = ranged.withColumn("_s", mean * F.col("_n"))
    outputs = {"mean_relative": F.try_divide(F.sum("_s"), F.sum("_n"))}
    return _with_total(scaled, [], by, outputs, label)


def run_lengths(df: DataFrame, by: list[str], scores: str) -> DataFrame:
    """Mean and longest score array per group (missing counts as 0) and 1 / mean (0 if 0)."""
    length = F.coalesce(F.array_size(F.col(scores)), F.lit(0))
    grouped = df.groupBy(*by).agg(F.avg(length).alias("average_length"), F.max(length).alias("longest"))
    return grouped.withColumn(
        "reciprocal", F.coalesce(F.try_divide(F.lit(1.0), F.col("average_length")), F.lit(0.0))
    )


def longest_overall(df: DataFrame, scores: str) -> DataFrame:
    """The longest score array of all rows, as one row."""
    return df.agg(F.coalesce(F.max(F.array_size(F.col(scores))), F.lit(0)).alias("longest"))


def null_by_bucket(positioned: DataFrame, pos: str, value: str, size: int = 100) -> DataFrame:
    """Missing values per bucket of ``size`` consecutive positions (``pos`` from 0)."""
    return positioned.groupBy(F.floor(F.col(pos) / size).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col(value).isNull().cast("long")).alias("n_missing"),
    )


def side_by_side(df: DataFrame, columns: list[str]) -> DataFrame:
    """Statistics table: one row per statistic, one column per method."""
    long = pin(df.select(*columns)).unpivot([], columns, "method", "score")
    simple = long.groupBy("method").agg(
        F.min("score").alias("Min"), F.max("score").alias("Max"), F.avg("score").alias("Mean")
    )
    medians = percentiles(long, ["method"], "score", {"Median": 0.5}).drop("n")
    tall = simple.join(medians, "method").unpivot(
        ["method"], ["Min", "Max", "Mean", "Median"], "statistic", "value"
    )
    return tall.groupBy("statistic").pivot("method", columns).agg(F.max("value"))


def scaled_by_size(curve: DataFrame, axis: str, by: str, value: str, label: str = "Average") -> DataFrame:
    """Scale an aggregated curve per group along its axis (0 if flat) and add the mean curve."""
    bounds = curve.groupBy(by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = (
        attach(curve, bounds, [by])
        .withColumn("scaled_score", min_max(F.col(value), F.col("_lo"), F.col("_hi"), "zero"))
        .select(axis, by, "scaled_score")
    )
    total = scaled.groupBy(axis).agg(F.avg("scaled_score").alias("scaled_score"))
    return scaled.unionByName(total.withColumn(by, F.lit(label)))
