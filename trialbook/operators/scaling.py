"""Group statistics joined back to rows: scaling, tolerances, outcome flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialbook.functions.scores import min_max, outcome
from trialbook.operators.attach import attach


def minmax_by(
    df: DataFrame,
    columns: list[str],
    by: list[str],
    shared: bool = False,
    on_degenerate: str = "null",
    prefix: str = "rel_",
    modes: dict[str, str] | None = None,
) -> DataFrame:
    """Scale columns to 0..1 within each group; ``shared`` uses one range for all of them.

    ``modes`` gives several results from one table of ranges: prefix and what an empty range
    gives (in place of ``prefix`` and ``on_degenerate``).
    """
    lows = [F.min(c) for c in columns]
    highs = [F.max(c) for c in columns]
    if shared and len(columns) > 1:
        lows = [F.least(*lows)] * len(columns)
        highs = [F.greatest(*highs)] * len(columns)
    stats = df.groupBy(*by).agg(
        *[x.alias(f"_lo_{c}") for c, x in zip(columns, lows)],
        *[x.alias(f"_hi_{c}") for c, x in zip(columns, highs)],
    )
    joined = attach(df, stats, by)
    for start, degenerate in (modes or {prefix: on_degenerate}).items():
        for c in columns:
            scaled = min_max(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}"), degenerate)
            joined = joined.withColumn(f"{start}{c}", scaled)
    return joined.drop(*[f"_{p}_{c}" for p in ("lo", "hi") for c in columns])


def score_difference(df: DataFrame, base: str, candidate: str) -> DataFrame:
    """Candidate minus base, and whether the candidate is better."""
    return df.withColumn("score_diff", F.col(candidate) - F.col(base)).withColumn(
        "llm_better", F.col("score_diff") > 0
    )


def outcome_flags(
    df: DataFrame, base: str, candidate: str, by: str, tolerance: float = 0.1
) -> DataFrame:
    """Better flag, correct-within-tolerance flag and outcome class per row.

    The tolerance of a group is its mean absolute base score divided by ``1 / tolerance``.
    """
    stats = df.groupBy(by).agg((F.avg(F.abs(F.col(base))) / (1.0 / tolerance)).alias("_tol"))
    flagged = attach(score_difference(df, base, candidate), stats, [by])
    return (
        flagged.withColumn("llm_correct", F.col("score_diff") > -F.col("_tol"))
        .withColumn("color", outcome(F.col("llm_better"), F.col("llm_correct")))
        .drop("_tol")
    )


def drop_infinite(df: DataFrame) -> DataFrame:
    """Keep rows without an infinite value in any float column; NaN and NULL are not infinite."""
    keep: Column = F.lit(True)
    for field in df.schema.fields:
        if field.dataType.typeName() in ("double", "float"):
            infinite = F.abs(F.col(f"`{field.name}`")) == F.lit(float("inf"))
            keep = keep & ~F.coalesce(infinite, F.lit(False))
    return df.filter(keep)


def complete_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with a missing value anywhere, or in ``subset``."""
    return df.na.drop("any", subset=subset)
