"""Joins and unions of scenario tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialbook.operators.ordering import positions
from trialbook.session import pin


def attach_controllers(scenarios: DataFrame, controllers: DataFrame, key: str = "scenario_id") -> DataFrame:
    """Every scenario with its controller, NULL where none was produced."""
    return scenarios.join(controllers, key, "left")


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys only in the left, only in the right, in both, and whether the sets are equal."""
    left = a.select(key).distinct().withColumn("_l", F.lit(1))
    right = b.select(key).distinct().withColumn("_r", F.lit(1))
    return (
        left.join(right, key, "full")
        .agg(
            F.count(F.when(F.col("_r").isNull(), 1)).alias("only_left"),
            F.count(F.when(F.col("_l").isNull(), 1)).alias("only_right"),
            F.count(F.when(F.col("_l") == F.col("_r"), 1)).alias("in_both"),
        )
        .withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))
    )


def paired_experiments(
    a: DataFrame, b: DataFrame, key: str, suffixes: tuple[str, str] = ("_formal", "_control")
) -> DataFrame:
    """Rows of two experiments side by side, shared columns suffixed; none unless the key sets are equal."""
    shared = [c for c in a.columns if c in b.columns and c != key]
    left = a.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = b.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    same = key_sets(a, b, key).select("equal").scalar()
    return left.join(right, key).filter(same)


def zip_rows(
    a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]
) -> DataFrame:
    """The i-th row of one table beside the i-th row of the other, to the shorter length."""
    left = positions(a, [], order_a, "_i").drop("_i_total")
    right = positions(b, [], order_b, "_i").drop("_i_total")
    return left.join(right, "_i").withColumnRenamed("_i", "row_no")


def fixed_controller(df: DataFrame, controllers: DataFrame, by: str = "type") -> DataFrame:
    """One fixed controller per category; NULL for a category without one."""
    return df.join(controllers, by, "left")


def concat(*parts: DataFrame) -> DataFrame:
    """Union by name; columns one part lacks become NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def tagged_union(parts: dict[str, DataFrame], tag: str = "Dataset") -> DataFrame:
    return concat(*[df.withColumn(tag, F.lit(name)) for name, df in parts.items()])


def by_position(df: DataFrame, position: Column, name: str = "dataset_position") -> DataFrame:
    """Epochs stored by their position: written once, a folder for each position, and read in one
    scan that takes the position from the folder, so a filter on it reads only its epochs."""
    return pin(df.withColumn(name, position), [name])
