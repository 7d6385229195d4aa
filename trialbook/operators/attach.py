"""Joining a per-key table to the rows it was computed from.

Group statistics have few rows, but nothing in the data proves it. The table is
therefore written once, its bytes are measured, and only then is it broadcast; a
larger one joins by key, where adaptive execution splits skewed partitions. The rows
are never shuffled by a key with few values, as a whole-group window would do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialbook.session import pin

BROADCAST_BYTES = 32 << 20


def measured_bytes(df: DataFrame) -> int:
    """Bytes of a pinned table: eight per fixed-width value, octets for text and bytes, text form for the rest."""
    parts = [F.lit(8)]
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0)))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            text = F.to_json(F.struct(F.col(f"`{field.name}`")))
            parts.append(F.coalesce(F.octet_length(text), F.lit(0)))
        else:
            parts.append(F.lit(8))
    width = reduce(lambda a, b: a + b, parts).cast("long")
    return df.agg(F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()["b"]


def planned_bytes(df: DataFrame) -> int:
    """The planner's own size estimate."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def planned_small(df: DataFrame) -> bool:
    """Whether the planner's own size estimate is below the session's broadcast threshold."""
    threshold = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return planned_bytes(df) <= threshold


def attach(
    rows: DataFrame,
    stats: DataFrame,
    on: list[str],
    how: str = "left",
    limit: int = BROADCAST_BYTES,
    null_safe: bool = False,
) -> DataFrame:
    """Join ``stats`` (one row per key) to ``rows``; broadcast it only after measuring it.

    Where the planner already knows the table to be small from the files below it, it is
    left to the planner and nothing is written.
    """
    side = stats
    if not planned_small(stats):
        stats = pin(stats)
        side = F.broadcast(stats) if measured_bytes(stats) <= limit else stats
    if not null_safe:
        return rows.join(side, on, how)
    side = side.withColumnsRenamed({k: f"_on_{k}" for k in on})
    condition: Column = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in on]
    )
    return rows.join(side, condition, how).drop(*[f"_on_{k}" for k in on])
