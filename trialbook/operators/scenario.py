"""Columns derived from a scenario's own fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialbook.functions.texts import clock


def category_labels(df: DataFrame, parameters: str = "parameters") -> DataFrame:
    """Kinds of objective, lights, arena and robots as columns."""
    return (
        df.withColumn("type", F.col(f"{parameters}.objective.kind"))
        .withColumn("lightstype", F.col(f"{parameters}.lights.kind"))
        .withColumn("arenatype", F.col(f"{parameters}.arena.kind"))
        .withColumn("robotstype", F.col(f"{parameters}.robots.kind"))
    )


def target_color_of(objective: Column) -> Column:
    """Colour of the targeted ground area: BLACK is black, anything else white."""
    area = F.when(
        objective["agg_target"] == 1, objective["ground_area_1"]["color"]
    ).otherwise(objective["ground_area_2"]["color"])
    return F.when(area == "BLACK", "black").otherwise("white")


def formal_view(df: DataFrame, text: str = "description", formal: str = "configuration") -> DataFrame:
    """The formal configuration takes the place of the text description."""
    return df.withColumn(text, F.col(formal))


def batch_plan(
    df: DataFrame, index: str, rows: int | Column, batches: int = 50,
    minutes_each: int = 150, setup_seconds: int = 300,
) -> DataFrame:
    """Batch number per row (``index`` from 0), rows per batch and the batch's time budget."""
    total = rows if isinstance(rows, Column) else F.lit(rows)
    per_batch = F.ceil(total / F.lit(float(batches)))
    seconds = per_batch * (minutes_each * 60) + setup_seconds
    return (
        df.withColumn("per_batch", per_batch)
        .withColumn("batch", F.floor(F.col(index) / F.col("per_batch")))
        .withColumn("budget_seconds", seconds)
        .withColumn("budget", clock(seconds))
    )
