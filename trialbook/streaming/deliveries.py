"""Deliveries of foraging robots over a stream of positions.

The state of a robot is whether it carries an item, how many it delivered, and the last
tick it was seen at. Ticks of a robot are put in order within a micro-batch. A tick at or
before the last one seen is late: its place in the order is gone. Late ticks are never lost
without a word: the state-store way returns them with a NULL count, the batch way writes them
to a table of their own, from which the robots concerned can be worked out again. A position
without a tick has no place at all and is left out.

There are two ways with equal results. ``deliver_batches`` handles each micro-batch as a
batch job that starts from the stored state of all robots. The ticks are cut into stretches by
ranges of (robot, tick); a stretch is summed up by its first and last zone and the deliveries
inside, and these summaries are put together in order, so one robot's rows are spread over
many tasks; beyond the micro-batch's own ticks only deliveries and summaries are written. ``stream_deliveries`` keeps the
state in Spark's state store, for short micro-batches: a task holds the rows of one
robot and one micro-batch, which the source's per-trigger limits bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trialbook.operators.attach import attach
from trialbook.operators.fitness import RUN, circle_pairs
from trialbook.operators.ordering import CHUNK, ranged
from trialbook.operators.spatial import in_circle
from trialbook.session import pin, remove, scratch

OUTPUT = "run_id string, robot_id string, tick long, delivered long"
STATE = "carries boolean, delivered long, tick long"


def zones(positions: DataFrame, circles: DataFrame, objectives: DataFrame) -> DataFrame:
    """Positions on exactly one of source and sink; joins the stream to static circle tables."""
    pairs = circle_pairs(circles, objectives, "foraging", "source", "sink").select(
        RUN,
        *[
            F.col(f"{c}.{f}").alias(f"_{c}_{f}")
            for c in ("first", "second")
            for f in ("x", "y", "radius")
        ],
    )
    placed = positions.join(pairs, RUN)

    def inside(c: str):
        return in_circle(
            F.col("x"), F.col("y"), F.col(f"_{c}_x"), F.col(f"_{c}_y"), F.col(f"_{c}_radius")
        )

    on_source, on_sink = inside("first"), inside("second")
    return placed.filter((on_source != on_sink) & F.col("tick").isNotNull()).select(
        RUN, "robot_id", F.col("tick").cast("long"), on_source.alias("at_source")
    )


def _step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    # most robots have a few ticks a micro-batch, so that a frame of pandas costs more than they do
    carries, delivered, last = state.get if state.exists else (False, 0, None)
    parts = [(b["tick"].to_numpy(), b["at_source"].to_numpy(dtype=bool)) for b in batches]
    ticks, at_source = (np.concatenate(p) if len(p) > 1 else p[0] for p in zip(*parts))
    order = np.argsort(ticks)
    ticks, at_source = ticks[order], at_source[order]
    # those up to the last tick seen are late
    new = int(np.searchsorted(ticks, last, "right")) if last is not None else 0
    late, ticks, at_source = ticks[:new], ticks[new:], at_source[new:]
    # a robot carries exactly if the zone before was the source
    before = np.concatenate([[carries], at_source[:-1]]) if len(ticks) else at_source
    drops = ticks[~at_source & before]
    if len(ticks):
        state.update((bool(at_source[-1]), delivered + len(drops), int(ticks[-1])))
    if len(drops) or len(late):
        count = pd.array([*range(delivered + 1, delivered + 1 + len(drops)), *[None] * len(late)], dtype="Int64")
        yield pd.DataFrame({"run_id": key[0], "robot_id": key[1], "tick": np.concatenate([drops, late]), "delivered": count})


def stream_deliveries(positions: DataFrame, circles: DataFrame, objectives: DataFrame) -> DataFrame:
    """One row per delivery with the robot's running count; ``positions`` is a stream.

    Late ticks are rows without a count. Bound the source's files per trigger: a task holds
    one robot's rows of one micro-batch.
    """
    return (
        zones(positions, circles, objectives)
        .groupBy(RUN, "robot_id")
        .applyInPandasWithState(_step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
    )


ROBOT = [RUN, "robot_id"]
#: Every so many micro-batches the state of all robots is written.
WHOLE = 10
ROBOT_STATE = "run_id string, robot_id string, tick long, at_source boolean, delivered long"
#: A delivery inside a stretch (tick, n: how many of the stretch with it), or with ``summary``
#: the stretch itself: its first and last tick and zone, its deliveries and its ticks.
STRETCHES = (
    f"run_id string, robot_id string, {CHUNK} int, summary boolean, tick long, n long, "
    "at_source boolean, last_tick long, last_at_source boolean, ticks long"
)


def _stretch_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ticks in order of robot and tick as rows of ``STRETCHES``, one batch at a time."""
    names = [c.split()[0] for c in STRETCHES.split(", ")]
    held: dict | None = None  # the robot's stretch so far

    def drops(of: dict, ticks: np.ndarray) -> pd.DataFrame:
        rows = pd.DataFrame({"tick": ticks, "n": np.arange(of["n"] + 1, of["n"] + 1 + len(ticks))})
        rows = rows.assign(**{c: of[c] for c in (*ROBOT, CHUNK)}, summary=False)
        return rows.assign(at_source=None, last_tick=None, last_at_source=None, ticks=None)[names]

    for batch in batches:
        if not len(batch):
            continue
        out, ended = [], []
        robots = batch[ROBOT].to_numpy(dtype=object)
        starts = np.flatnonzero(np.r_[True, (robots[1:] != robots[:-1]).any(axis=1)])
        all_ticks, zone = batch["tick"].to_numpy(), batch["at_source"].to_numpy(dtype=bool)
        for start, end in zip(starts, [*starts[1:], len(batch)]):
            ticks, at_source = all_ticks[start:end], zone[start:end]
            if held is None or [held[c] for c in ROBOT] != list(robots[start]):
                ended += [held] * (held is not None)
                held = dict(zip(ROBOT, robots[start])) | {CHUNK: int(batch[CHUNK].iloc[start]), "summary": True, "n": 0, "ticks": 0}
                held |= {"tick": int(ticks[0]), "at_source": bool(at_source[0])}
                carries = False  # what the stretches before bring is not known here
            else:
                carries = held["last_at_source"]
            found = ticks[~at_source & np.r_[carries, at_source[:-1]]]
            if len(found):
                out.append(drops(held, found))
            held["n"] += len(found)
            held["ticks"] += len(ticks)
            held |= {"last_tick": int(ticks[-1]), "last_at_source": bool(at_source[-1])}
        if ended:
            out.append(pd.DataFrame(ended)[names])
        if out:
            yield pd.concat(out)
    if held is not None:
        yield pd.DataFrame([held])[names]


def stretches(ticks: DataFrame) -> DataFrame:
    """Ticks (run, robot, tick, at_source) as rows of ``STRETCHES``: the ranges of (robot, tick)
    are the tasks, so a robot with most of the ticks is many stretches."""
    rows = ranged(ticks, [*ROBOT, "tick"]).sortWithinPartitions(*ROBOT, "tick")
    return rows.withColumn(CHUNK, F.spark_partition_id()).mapInPandas(_stretch_rows, STRETCHES)


def composed(summaries: DataFrame, prior: DataFrame) -> DataFrame:
    """Each stretch with ``_first`` (1 if its first tick is a delivery, else 0) and ``_base``, the
    robot's deliveries before the stretch. ``prior``: the robots' states before all of them."""
    known = prior.select(*ROBOT, F.col("at_source").alias("_carried"), F.col("delivered").alias("_before"))
    order = Window.partitionBy(*ROBOT).orderBy(CHUNK)
    entered = F.coalesce(F.lag("last_at_source").over(order), "_carried", F.lit(False))
    rows = attach(summaries, known, ROBOT).withColumn("_first", (~F.col("at_source") & entered).cast("long"))
    sums = F.sum(F.col("n") + F.col("_first")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_base", F.coalesce("_before", F.lit(0)) + F.coalesce(sums, F.lit(0)))


def _latest(versions: DataFrame) -> DataFrame:
    """The last state of each robot among several versions."""
    newest = versions.groupBy(*ROBOT).agg(F.max(F.struct("tick", "at_source", "delivered")).alias("_s"))
    return newest.select(*ROBOT, "_s.tick", "_s.at_source", "_s.delivered")


def deliver_batches(
    positions: DataFrame,
    circles: DataFrame,
    objectives: DataFrame,
    target: str,
    state: str,
    checkpoint: str,
    late: str | None = None,
) -> None:
    """Append the deliveries of each micro-batch to ``target``, until the source is used up.

    Version n of the state holds the robots that micro-batch n has seen, every ``WHOLE``-th
    one all robots; a batch reads the versions from the last whole one on, and what lies
    before the one before that is removed. Run again after a failure it reads and overwrites
    the same versions, so nothing counts twice. Late ticks go to ``late`` (``state``/late if
    not given), a folder per batch.
    """
    late = late or f"{state}/late"

    def write(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):  # the tables of a micro-batch go with it
            advance(batch, number)

    def advance(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        since = max(0, (number - 1) // WHOLE * WHOLE)
        if number > 0:
            versions = [f"{state}/version={n}" for n in range(since, number)]
            prior = _latest(spark.read.schema(ROBOT_STATE).parquet(*versions))
        else:
            prior = spark.createDataFrame([], ROBOT_STATE)
        placed = pin(attach(pin(zones(batch, circles, objectives)), prior.select(*ROBOT, F.col("tick").alias("_seen")), ROBOT))
        in_time = F.col("_seen").isNull() | (F.col("tick") > F.col("_seen"))
        placed.filter(~in_time).select(*ROBOT, "tick", "at_source").write.mode("overwrite").parquet(f"{late}/batch={number}")
        found = pin(stretches(placed.filter(in_time).drop("_seen")))
        whole = pin(composed(found.filter("summary"), prior))
        inside = attach(found.filter("not summary"), whole.select(*ROBOT, CHUNK, "_first", "_base"), [*ROBOT, CHUNK], "inner")
        entries = whole.filter("_first = 1").select(*ROBOT, "tick", (F.col("_base") + 1).alias("delivered"))
        counted = inside.select(*ROBOT, "tick", (F.col("_base") + F.col("_first") + F.col("n")).alias("delivered"))
        counted.unionByName(entries).write.mode("overwrite").parquet(f"{target}/batch={number}")

        reached = F.struct("last_tick", "last_at_source", (F.col("_base") + F.col("_first") + F.col("n")).alias("delivered"))
        after = whole.groupBy(*ROBOT).agg(F.max_by(reached, CHUNK).alias("_s"))
        after = after.select(
            *ROBOT, F.col("_s.last_tick").alias("tick"), F.col("_s.last_at_source").alias("at_source"), "_s.delivered"
        )
        if number % WHOLE == 0:
            after = after.unionByName(prior.join(after.select(*ROBOT), ROBOT, "left_anti"))
        after.write.mode("overwrite").parquet(f"{state}/version={number}")
        for n in range(max(0, since - WHOLE), since):
            remove(spark, f"{state}/version={n}")

    started = (
        positions.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()


def run_to_end(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Process everything there is, in append mode, to Parquet files at ``target``."""
    started = (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
