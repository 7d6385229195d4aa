"""Wide to long and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialbook.functions.texts import first_integer


def melt(df: DataFrame, ids: list[str], values: list[str], var: str = "score_type", val: str = "score"):
    return df.unpivot(ids, values, var, val)


def to_long(df: DataFrame, ids: list[str], a: str, b: str) -> DataFrame:
    """Two score columns as rows of method A and method B."""
    pair = F.array(
        F.struct(F.lit("A").alias("method"), F.col(a).alias("score")),
        F.struct(F.lit("B").alias("method"), F.col(b).alias("score")),
    )
    return df.select(*ids, F.inline(pair))


def pivot_stats(
    df: DataFrame, index: str, columns: str, value: str, categories: list[str],
    stats: tuple[str, ...] = ("min", "mean", "max"),
) -> DataFrame:
    """One row per index, one column per category and statistic.

    The categories are named by the caller, so no extra pass looks for them.
    """
    functions = {"min": F.min, "mean": F.avg, "max": F.max}
    return (
        df.groupBy(index)
        .pivot(columns, categories)
        .agg(*[functions[s](value).alias(s) for s in stats])
    )


def stats_long(table: DataFrame, ids: list[str], statistics: list[str]) -> DataFrame:
    typed = table.select(*ids, *[F.col(c).cast("double").alias(c) for c in statistics])
    return typed.unpivot(ids, statistics, "statistic", "value")


def explode_scores(df: DataFrame, ids: list[str], scores: str) -> DataFrame:
    return df.select(*ids, F.posexplode(scores).alias("pos", "score"))


def size_curve(df: DataFrame, dataset: str, by: str, value: str) -> DataFrame:
    """(x_value, group, mean): the x value is the first number in the dataset's name."""
    means = df.groupBy(dataset, by).agg(F.avg(value).alias("mean_score"))
    sized = means.withColumn("x_value", first_integer(F.col(dataset)))
    return sized.filter("x_value is not null").select("x_value", by, "mean_score")
