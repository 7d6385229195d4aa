"""Mission scores from robot positions.

Tables: ``positions`` (run_id, robot_id, tick, x, y), ``circles`` (run_id, circle_no, x, y,
radius, color) and ``objectives`` (run_id, kind, target_color, conn_start, conn_end,
connection_range, area_w, area_h, source, sink). Scores of the end of a run use the last
position of each robot.

The sample points of the connection and distribution missions form a line or a square
lattice, so the nearest one is found by arithmetic on each position; no point table is
made and nothing is joined per point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialbook.operators.attach import attach
from trialbook.operators.ordering import previous
from trialbook.operators.spatial import bounding_box, distance, in_circle
from trialbook.session import pin

RUN, ROBOT = "run_id", "robot_id"
KINDS = ("aggregation", "connection", "distribution", "foraging")


def final_positions(positions: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Last position of each robot in each run."""
    last = positions.groupBy(RUN, ROBOT).agg(
        F.max_by(F.struct("x", "y", *(extra or [])), F.col("tick")).alias("_p")
    )
    return last.select(RUN, ROBOT, "_p.*")


def target_circles(circles: DataFrame, objectives: DataFrame) -> DataFrame:
    """The last circle of the target colour of each aggregation run."""
    wanted = objectives.filter(F.col("kind") == "aggregation").select(RUN, "target_color")
    matching = circles.join(wanted, RUN).filter(F.col("color") == F.col("target_color"))
    return (
        matching.groupBy(RUN)
        .agg(F.max_by(F.struct("x", "y", "radius"), F.col("circle_no")).alias("target"))
    )


def circle_pairs(circles: DataFrame, objectives: DataFrame, kind: str, a: str, b: str) -> DataFrame:
    """The circles of two colours in each run: the last ones seen when both colours are known."""
    wanted = objectives.filter(F.col("kind") == kind).select(
        RUN, F.col(a).alias("_a"), F.col(b).alias("_b")
    )
    is_a = F.col("color") == F.col("_a")
    is_b = (F.col("color") == F.col("_b")) & (F.col("color") != F.col("_a"))
    listed = circles.join(wanted, RUN).select("*", is_a.alias("_is_a"), is_b.alias("_is_b"))
    stops = (
        listed.groupBy(RUN)
        .agg(
            F.min(F.when(F.col("_is_a"), F.col("circle_no"))).alias("_fa"),
            F.min(F.when(F.col("_is_b"), F.col("circle_no"))).alias("_fb"),
        )
        .filter("_fa is not null and _fb is not null")
        .select(RUN, F.greatest("_fa", "_fb").alias("_stop"))
    )
    known = listed.join(stops, RUN).filter(F.col("circle_no") <= F.col("_stop"))
    place = F.struct("x", "y", "radius")
    return known.groupBy(RUN).agg(
        F.max_by(F.when(F.col("_is_a"), place), F.when(F.col("_is_a"), F.col("circle_no"))).alias("first"),
        F.max_by(F.when(F.col("_is_b"), place), F.when(F.col("_is_b"), F.col("circle_no"))).alias("second"),
    )


def _all_runs(scores: DataFrame, objectives: DataFrame, kind: str) -> DataFrame:
    runs = objectives.filter(F.col("kind") == kind).select(RUN)
    return runs.join(scores, RUN, "left").select(
        RUN, F.lit(kind).alias("kind"), F.coalesce("fitness", F.lit(0.0)).alias("fitness")
    )


def aggregation_fitness(positions: DataFrame, circles: DataFrame, objectives: DataFrame) -> DataFrame:
    """Share of robots that end inside the target circle; 0 without robots or target."""
    ends = final_positions(attach(positions, target_circles(circles, objectives), [RUN], "inner"), ["target"])
    inside = in_circle(
        F.col("x"), F.col("y"), F.col("target.x"), F.col("target.y"), F.col("target.radius")
    )
    scores = ends.groupBy(RUN).agg(F.avg(inside.cast("double")).alias("fitness"))
    return _all_runs(scores, objectives, "aggregation")


def _closer(value: Column, step: Column, last: Column) -> Column:
    """Index 0..last of the nearest multiple of ``step``; ties go down."""
    low = F.greatest(F.lit(0), F.least(last, F.floor(F.coalesce(F.try_divide(value, step), F.lit(0.0)))))
    high = F.least(last, low + 1)
    return F.when(F.abs(value - low * step) <= F.abs(value - high * step), low).otherwise(high)


def line_assignment(positions: DataFrame, circles: DataFrame, objectives: DataFrame) -> DataFrame:
    """Nearest sample point on the start-to-end line for each robot of a connection run.

    The line has n + 1 points, n = floor(length / range); n is at least 1 here, where the
    original divides by zero.
    """
    reach = objectives.filter(F.col("kind") == "connection").select(RUN, "connection_range")
    lines = circle_pairs(circles, objectives, "connection", "conn_start", "conn_end").join(reach, RUN)
    ends = final_positions(
        attach(positions, lines, [RUN], "inner"), ["first", "second", "connection_range"]
    )
    sx, sy = F.col("first.x"), F.col("first.y")
    ex, ey = F.col("second.x"), F.col("second.y")
    length = distance(sx, sy, ex, ey)
    n = F.greatest(F.floor(F.try_divide(length, F.col("connection_range"))), F.lit(1))
    along = F.try_divide(
        (F.col("x") - sx) * (ex - sx) + (F.col("y") - sy) * (ey - sy), length * length
    )
    low = F.greatest(F.lit(0), F.least(n, F.floor(F.coalesce(along, F.lit(0.0)) * n)))
    high = F.least(n, low + 1)

    def to_point(i: Column) -> Column:
        t = i / n
        return distance(F.col("x"), F.col("y"), sx + t * (ex - sx), sy + t * (ey - sy))

    with_ends = ends.withColumn("_lo", low).withColumn("_hi", high)
    near_low = to_point(F.col("_lo")) <= to_point(F.col("_hi"))
    return with_ends.select(
        RUN,
        ROBOT,
        F.when(near_low, F.col("_lo")).otherwise(F.col("_hi")).alias("point"),
        F.least(to_point(F.col("_lo")), to_point(F.col("_hi"))).alias("dist"),
    )


def lattice_assignment(positions: DataFrame, objectives: DataFrame) -> DataFrame:
    """Nearest point of the square lattice around the robots' bounding box, per robot."""
    areas = objectives.filter(F.col("kind") == "distribution").select(
        RUN,
        F.col("connection_range").alias("_step"),
        F.sqrt(F.col("area_w") * F.col("area_h")).alias("_side"),
    )
    ends = final_positions(attach(positions, areas, [RUN], "inner"), ["_step", "_side"])
    boxed = attach(ends, bounding_box(ends, [RUN]).select(RUN, "center_x", "center_y"), [RUN], "inner")
    step, side = F.col("_step"), F.col("_side")
    last = F.floor(side / step + 1e-9)
    px = F.col("x") - (F.col("center_x") - side / 2.0)
    py = F.col("y") - (F.col("center_y") - side / 2.0)
    ix, iy = _closer(px, step, last), _closer(py, step, last)
    return boxed.select(
        RUN,
        ROBOT,
        (ix * (last + 1) + iy).alias("point"),
        distance(px, py, ix * step, iy * step).alias("dist"),
    )


def _spread(assigned: DataFrame) -> DataFrame:
    """Sum of distances and number of robots on shared points, per run."""
    per_point = assigned.groupBy(RUN, "point").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("dist").alias("_d")
    )
    return per_point.groupBy(RUN).agg(
        F.sum("_d").alias("total_distance"),
        F.sum(F.when(F.col("_n") >= 2, F.col("_n")).otherwise(F.lit(0))).alias("crowded"),
    )


def connection_fitness(positions: DataFrame, circles: DataFrame, objectives: DataFrame) -> DataFrame:
    spread = _spread(line_assignment(positions, circles, objectives))
    value = -F.col("total_distance") - F.col("crowded") / 10.0
    return _all_runs(spread.select(RUN, value.alias("fitness")), objectives, "connection")


def distribution_fitness(positions: DataFrame, objectives: DataFrame) -> DataFrame:
    spread = _spread(lattice_assignment(positions, objectives))
    value = -F.col("crowded") - F.col("total_distance")
    return _all_runs(spread.select(RUN, value.alias("fitness")), objectives, "distribution")


def zone_visits(positions: DataFrame, circles: DataFrame, objectives: DataFrame) -> DataFrame:
    """Ticks on exactly one of source and sink, with the robot's previous such zone.

    A robot carries an item exactly when its last exclusive zone was the source, so the
    carry state is a look-back of one row.
    """
    pairs = circle_pairs(circles, objectives, "foraging", "source", "sink")
    placed = attach(positions, pairs, [RUN], "inner")
    x, y = F.col("x"), F.col("y")
    on_source = in_circle(x, y, F.col("first.x"), F.col("first.y"), F.col("first.radius"))
    on_sink = in_circle(x, y, F.col("second.x"), F.col("second.y"), F.col("second.radius"))
    zone = F.when(on_source & ~on_sink, "source").when(on_sink & ~on_source, "sink")
    visits = placed.select(RUN, ROBOT, "tick", zone.alias("zone")).filter("zone is not null")
    return previous(visits, [RUN, ROBOT], ["tick"], ["zone"])


def _dropped() -> Column:
    return (F.col("zone") == "sink") & F.coalesce(F.col("prev_zone") == "source", F.lit(False))


def _picked() -> Column:
    return (F.col("zone") == "source") & F.coalesce(F.col("prev_zone") != "source", F.lit(True))


def deliveries(positions: DataFrame, circles: DataFrame, objectives: DataFrame) -> DataFrame:
    """Items each robot carried from source to sink."""
    visits = zone_visits(positions, circles, objectives)
    return visits.groupBy(RUN, ROBOT).agg(F.sum(_dropped().cast("long")).alias("delivered"))


def foraging_counters(positions: DataFrame, circles: DataFrame, objectives: DataFrame) -> DataFrame:
    """Pick-ups, drops and robots on either area per tick (ticks without any are left out)."""
    visits = zone_visits(positions, circles, objectives)
    return visits.groupBy(RUN, "tick").agg(
        F.sum(_picked().cast("long")).alias("picked_up"),
        F.sum(_dropped().cast("long")).alias("dropped"),
        F.sum((F.col("zone") == "source").cast("long")).alias("on_source"),
        F.sum((F.col("zone") == "sink").cast("long")).alias("on_sink"),
    )


def foraging_fitness(positions: DataFrame, circles: DataFrame, objectives: DataFrame) -> DataFrame:
    counted = deliveries(positions, circles, objectives)
    scores = counted.groupBy(RUN).agg(F.sum("delivered").cast("double").alias("fitness"))
    return _all_runs(scores, objectives, "foraging")


def fitness(positions: DataFrame, circles: DataFrame, objectives: DataFrame) -> DataFrame:
    """Score of every run by the formula of its kind; an unknown kind raises an error.

    The positions are read once and laid down by kind, so that each formula reads its own.
    """
    message = F.concat(F.lit("objective not implemented: "), F.coalesce("kind", F.lit("NULL")))
    unknown = objectives.filter(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))).select(
        RUN, "kind", F.raise_error(message).cast("double").alias("fitness")
    )
    kinds = objectives.filter(F.col("kind").isin(*KINDS)).select(RUN, F.col("kind").alias("_kind"))
    laid = pin(attach(positions.select(RUN, ROBOT, "tick", "x", "y"), kinds, [RUN], "inner"), ["_kind"])

    def of(kind: str) -> DataFrame:
        return laid.filter(F.col("_kind") == kind).drop("_kind")

    return (
        aggregation_fitness(of("aggregation"), circles, objectives)
        .unionByName(connection_fitness(of("connection"), circles, objectives))
        .unionByName(distribution_fitness(of("distribution"), objectives))
        .unionByName(foraging_fitness(of("foraging"), circles, objectives))
        .unionByName(unknown)
    )
