"""Reproducible splits: every draw is a position in a seeded md5 order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialbook.operators.ordering import hash_intervals, hash_positions, positions

#: Rows that one task may hold when a slice is taken by sorting.
SHALLOW = 100_000


def _complete(df: DataFrame) -> DataFrame:
    """Every split starts from the complete rows; so a missing key is never drawn."""
    return df.na.drop("any")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Seeded permutation of the complete rows; ``pos`` counts from 1."""
    return hash_positions(_complete(df), key, seed).drop("pos_total")


def holdout(df: DataFrame, key: str, n_validation: int = 250, n_train: int = 2250, seed: int = 42) -> DataFrame:
    """First rows of the shuffled order as validation, the next ones as train."""
    cuts = [F.lit(n_validation), F.lit(n_validation + n_train)]
    drawn = hash_intervals(_complete(df), key, lambda total: cuts, seed).filter(F.col("interval") < 2)
    split = F.when(F.col("interval") == 0, "validation").otherwise("train")
    return drawn.withColumn("split", split).drop("interval")


def train_validation(
    df: DataFrame, key: str, validation: float | None = 0.2, seed: int = 42
) -> DataFrame:
    """Exact-size random split (a quarter when no share is given); validation is rounded up."""
    share = 0.25 if validation is None else validation
    drawn = hash_intervals(_complete(df), key, lambda total: [F.ceil(total * F.lit(share))], seed)
    split = F.when(F.col("interval") == 0, "validation").otherwise("train")
    return drawn.withColumn("split", split).drop("interval")


def size_ladder(df: DataFrame, key: str, steps: int = 10, seed: int = 42) -> DataFrame:
    """Nested prefixes of the shuffled order: ``rung`` is the smallest step that holds the row.

    Step k of the ladder is ``rung <= k``; one row per input row serves all steps, and
    written with ``partitionBy("rung")`` each step reads only its own folders.
    """

    def cuts(total: Column) -> list[Column]:
        # total * k // steps in whole numbers
        return [((total * k) - (total * k) % steps) / steps for k in range(1, steps)]

    drawn = hash_intervals(_complete(df), key, cuts, seed)
    return drawn.withColumn("rung", F.col("interval").cast("long") + 1).drop("interval")


def ladder_step(ladder: DataFrame, step: int) -> DataFrame:
    return ladder.filter(F.col("rung") <= step)


def ladder_sizes(ladder: DataFrame, steps: int = 10) -> DataFrame:
    """Rows in each step: counts per rung, summed up the ladder."""
    counts = ladder.groupBy("rung").agg(F.count(F.lit(1)).alias("_n"))
    reached = counts.select(F.explode(F.sequence("rung", F.lit(steps).cast("long"))).alias("step"), "_n")
    return reached.groupBy("step").agg(F.sum("_n").alias("size"))


def row_ids(df: DataFrame, order: list[str], out: str = "original_index") -> DataFrame:
    """Row number from 0 over a declared unique order."""
    numbered = positions(df, [], order, "_pos").drop("_pos_total")
    return numbered.withColumn(out, F.col("_pos") - 1).drop("_pos")


def first_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """First k rows of an order; each task keeps at most k rows before they meet, so k is
    bounded by ``SHALLOW``."""
    if k > SHALLOW:
        raise ValueError(f"first_k serves up to {SHALLOW} rows; take more by position")
    return df.orderBy(*order).limit(k)


def row_slice(df: DataFrame, order: list[str], offset: int, count: int) -> DataFrame:
    """``count`` rows after the first ``offset`` of a unique order.

    For shallow slices each task keeps offset + count rows at most; deep ones are cut out by
    position, which orders only the keys of a wide table.
    """
    if offset + count <= SHALLOW:
        return df.orderBy(*order).offset(offset).limit(count)
    numbered = row_ids(df, order, "_at")
    return numbered.filter((F.col("_at") >= offset) & (F.col("_at") < offset + count)).drop("_at")


def attribute_split(df: DataFrame, condition: Column, key: str, k: int, seed: int = 42) -> DataFrame:
    """First k rows, in seeded order, of those with an attribute."""
    hashed = df.filter(condition).withColumn(
        "_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    )
    return first_k(hashed, [F.col("_h"), F.col(key)], k).drop("_h")


def leave_one_out(df: DataFrame, by: str, category: str) -> DataFrame:
    """Rows of one category apart from all others (rows without category in neither)."""
    side = F.when(F.col(by) == category, "held_out").when(F.col(by) != category, "rest")
    return df.withColumn("split", side).filter("split is not null")


def pick_one(variants: Column, key: Column, seed: int = 42) -> Column:
    """One entry of an array, drawn by a hash of the key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.when(F.size(variants) > 0, F.get(variants, (draw % F.size(variants)).cast("int")))
