"""Motion between frames: masks, recency-weighted traces, linked tracks, thinning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialbook.operators.attach import attach
from trialbook.operators.ordering import chunk, positions, previous, running_total
from trialbook.operators.spatial import distance
from trialbook.session import pin

#: Detections of a stretch of frames.
CHUNK_ROWS = 100_000

def motion_mask(
    df: DataFrame, by: list[str], order: str, value: str, threshold: float = 30.0
) -> DataFrame:
    """Absolute change to the previous frame and whether it exceeds the threshold."""
    looked = previous(df, by, [order], [value])
    change = F.abs(F.col(value) - F.col(f"prev_{value}"))
    return looked.withColumn("change", change).withColumn(
        "moved", F.coalesce(F.col("change") > threshold, F.lit(False))
    )


def motion_trace(
    df: DataFrame,
    clip: str,
    cell: str,
    frame: str,
    value: str,
    threshold: float = 30.0,
    decay: float = 5.0,
) -> DataFrame:
    """Recency-weighted sum of the motion mask per cell, clipped to 0..255."""
    lengths = df.groupBy(clip).agg((F.max(frame) + 1).alias("_n"))
    masked = attach(motion_mask(df, [clip, cell], frame, value, threshold), lengths, [clip])
    age = (F.col("_n") - F.col(frame)) / F.col("_n")
    weight = F.when(F.col("moved"), F.lit(255.0) * F.exp(-F.lit(decay) * age)).otherwise(F.lit(0.0))
    summed = masked.groupBy(clip, cell).agg(F.sum(weight).alias("trace"))
    return summed.withColumn("trace", F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("trace"))))


def every_nth(df: DataFrame, by: list[str], order: list[str], n: int = 10) -> DataFrame:
    """Every n-th row of each group."""
    return positions(df, by, order, "_pos").filter(F.col("_pos") % n == 0).drop("_pos", "_pos_total")


def link_tracks(
    df: DataFrame,
    clip: str = "clip",
    frame: str = "frame",
    det: str = "det",
    index: int = 0,
    max_dist: float = 50.0,
    start: str | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Greedy track of one object per clip: the detections it moves to, frame by frame.

    A track starts at detection ``index`` of frame 0, or at the rows a boolean column
    ``start`` marks there (one per clip), goes to the nearest detection closer
    than ``max_dist`` in the next frame, and ends at the first frame without one. The
    step a track takes depends only on the detection it is at, so all steps are found at
    once by a grid join of neighbouring frames. Frames are put together to stretches of
    ``chunk_rows`` detections (or one frame of more); each stretch tells, by itself, at which
    detection of the next one a track leaves that enters at a given one. The stretches a track
    enters follow from these few rows, and each stretch then lists its own part of the path.
    """
    begins = F.col(start) if start else F.col(det) == index
    base = pin(
        df.select(F.col(clip).alias("_c"), F.col(frame).cast("long").alias("_f"),
                  F.col(det).alias("_d"), "x", "y", begins.alias("_s"))
    )
    cell = float(max_dist)
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    here = (
        base.withColumn("_ox", F.explode(around))
        .withColumn("_oy", F.explode(around))
        .withColumn("_cx", F.floor(F.col("x") / cell) + F.col("_ox"))
        .withColumn("_cy", F.floor(F.col("y") / cell) + F.col("_oy"))
        .withColumn("_next", F.col("_f") + 1)
    )
    there = base.select(
        "_c",
        F.col("_f").alias("_next"),
        F.col("_d").alias("_d2"),
        F.col("x").alias("_x2"),
        F.col("y").alias("_y2"),
        F.floor(F.col("x") / cell).alias("_cx"),
        F.floor(F.col("y") / cell).alias("_cy"),
    )
    gap = distance(F.col("x"), F.col("y"), F.col("_x2"), F.col("_y2"))
    counts = base.groupBy("_c", "_f").agg(F.count(F.lit(1)).alias("_n"))
    upto = running_total(chunk(counts, ["_c"], ["_f"]), ["_c"], ["_f"], {"_upto": F.col("_n")})
    stretch = F.floor((F.col("_upto") - F.col("_n")) / F.lit(chunk_rows)).cast("long")
    frames = upto.select("_c", "_f", stretch.alias("_k"))
    nearest_one = (
        here.join(there, ["_c", "_next", "_cx", "_cy"])
        .withColumn("_gap", gap)
        .filter(F.col("_gap") < max_dist)
        .groupBy("_c", "_f", "_d")
        .agg(F.min(F.struct("_gap", "_d2", "_x2", "_y2")).alias("_b"))
        .select("_c", "_f", "_d", "_b._d2", "_b._x2", "_b._y2")
    )
    steps = pin(nearest_one.join(frames, ["_c", "_f"]))
    entries = base.filter((F.col("_f") == 0) & F.col("_s")).join(frames.filter("_f = 0"), ["_c", "_f"]).select("_c", "_k", "_f", "_d")
    if not steps.filter("_k > 0").isEmpty():
        entries = _entered(steps, pin(entries), frames)
    begun = steps.join(entries.withColumnsRenamed({"_f": "_f0", "_d": "_d0"}), ["_c", "_k"])

    def expand(rows):
        frame_at, det_at = rows["_f0"].iloc[0], rows["_d0"].iloc[0]
        places = dict(zip(zip(rows["_f"], rows["_d"]), range(len(rows))))
        after, path = rows["_d2"].tolist(), []
        while (at := places.get((frame_at, det_at))) is not None:
            path.append(at)
            frame_at, det_at = frame_at + 1, after[at]
        found = rows.iloc[path]
        return found.assign(_f=found["_f"] + 1)[["_c", "_f", "_d2", "_x2", "_y2"]]

    kinds = {f.name: f.dataType.simpleString() for f in steps.schema}
    listed = ", ".join(f"{c} {kinds[c]}" for c in ("_c", "_f", "_d2", "_x2", "_y2"))
    path = begun.groupBy("_c", "_k").applyInPandas(expand, listed)
    return path.toDF(clip, frame, det, "x", "y")


def _entered(steps: DataFrame, entries: DataFrame, frames: DataFrame) -> DataFrame:
    """The stretches that tracks enter, with the frame and detection where they do. ``entries``:
    those of the first stretches. Each round doubles the stretches that a jump passes."""
    starts = frames.groupBy("_c", "_k").agg(F.min("_f").alias("_f0"), F.max("_f").alias("_f9"))
    within = steps.join(starts, ["_c", "_k"])

    def leave(rows):
        """For each detection of the first frame the one beyond the last frame it leads to."""
        clip, first, last = rows[["_c", "_f0", "_f9"]].iloc[0]
        after = dict(zip(zip(rows["_f"], rows["_d"]), rows["_d2"]))
        out = []
        for det in rows.loc[rows["_f"] == first, "_d"]:
            at, now = first, det
            while (at, now) in after:
                now, at = after[at, now], at + 1
            if at == last + 1:
                out.append((clip, first, det, at, now))
        return pd.DataFrame(out, columns=["_c", "_f", "_d", "_tf", "_td"])

    kinds = {f.name: f.dataType.simpleString() for f in steps.schema}
    form = f"_c {kinds['_c']}, _f long, _d {kinds['_d']}, _tf long, _td {kinds['_d2']}"
    jumps = pin(within.groupBy("_c", "_k").applyInPandas(leave, form))
    reached = entries.select("_c", "_f", "_d")
    while True:
        hop = pin(reached.join(jumps, ["_c", "_f", "_d"]).select("_c", F.col("_tf").alias("_f"), F.col("_td").alias("_d")))
        if hop.isEmpty():
            break
        reached = pin(reached.unionByName(hop))
        onward = jumps.select("_c", F.col("_f").alias("_tf"), F.col("_d").alias("_td"), F.col("_tf").alias("_uf"), F.col("_td").alias("_ud"))
        jumps = pin(
            jumps.join(onward, ["_c", "_tf", "_td"]).select("_c", "_f", "_d", F.col("_uf").alias("_tf"), F.col("_ud").alias("_td"))
        )
    return reached.join(frames, ["_c", "_f"])
