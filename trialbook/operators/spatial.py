"""Points against circles, rectangles and target points, as equi-joins on grid cells.

Each area is listed under the cells of a grid whose cell size fits it (the power of two from
its extent up), so it lies in four cells at most, however large it is; each point is listed
under its cell in every grid in use. An inequality join becomes a join on (run, grid, cell)
that spreads one busy run over all of its cells. The listed areas are measured before they
are broadcast. Nearest targets are searched down a tree of boxes that refines itself where the
targets are. Areas and points with a coordinate that is NULL, NaN or infinite meet nothing.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialbook.operators.attach import attach
from trialbook.session import pin

EDGE = 1e-9


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def _cell(value: Column, size: Column | float) -> Column:
    return F.floor(value / (size if isinstance(size, Column) else F.lit(size)))


def _finite(*values: Column) -> Column:
    """Whether all values are numbers of finite size."""
    tests = [F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)) for x in values]
    return reduce(lambda a, b: a & b, tests)


def _covering(areas: DataFrame, x: Column, y: Column, ex: Column, ey: Column) -> DataFrame:
    """List each area under the cells its bounding box touches, in the grid ``_level`` whose
    cells are at least as wide as the area."""
    areas = areas.filter(_finite(x, y, ex, ey))
    extent = F.greatest(ex, ey, F.lit(EDGE)) * 2 + 2 * EDGE
    areas = areas.withColumn("_level", F.ceil(F.log2(extent)).cast("int"))
    size = F.pow(F.lit(2.0), F.col("_level"))
    span_x = F.sequence(_cell(x - ex - EDGE, size), _cell(x + ex + EDGE, size))
    span_y = F.sequence(_cell(y - ey - EDGE, size), _cell(y + ey + EDGE, size))
    return areas.withColumn("_cx", F.explode(span_x)).withColumn("_cy", F.explode(span_y))


def in_circle(px: Column, py: Column, cx: Column, cy: Column, radius: Column) -> Column:
    return distance(px, py, cx, cy) <= radius


def in_rectangle(
    px: Column, py: Column, cx: Column, cy: Column, w: Column, h: Column, angle_deg: Column
) -> Column:
    """Strictly inside a turned rectangle; ``w`` and ``h`` are half-extents, the turn is clockwise."""
    turn = F.radians(angle_deg)
    dx, dy = px - cx, py - cy
    u = dx * F.cos(turn) - dy * F.sin(turn)
    v = dx * F.sin(turn) + dy * F.cos(turn)
    return (F.abs(u) < w) & (F.abs(v) < h)


def _celled_points(points: DataFrame, size: float) -> DataFrame:
    return points.withColumn("_cx", _cell(F.col("x"), size)).withColumn(
        "_cy", _cell(F.col("y"), size)
    )


def _levels(areas: DataFrame) -> list[int]:
    """The grids in use: one per power of two that areas are as wide as."""
    return sorted(r[0] for r in areas.select("_level").distinct().collect())


CELL = ["_level", "_cx", "_cy"]


def _meet(points: DataFrame, areas: DataFrame, run: str) -> DataFrame:
    """Points with the areas listed under their cells."""
    areas = pin(areas)
    levels = F.array(*map(F.lit, _levels(areas))).cast("array<int>")
    listed = points.filter(_finite(F.col("x"), F.col("y"))).withColumn("_level", F.explode(levels))
    size = F.pow(F.lit(2.0), F.col("_level"))
    listed = listed.withColumn("_cx", _cell(F.col("x"), size)).withColumn("_cy", _cell(F.col("y"), size))
    return attach(listed, areas, [run, *CELL], how="inner").drop(*CELL)


def _celled_circles(circles: DataFrame, run: str) -> DataFrame:
    named = circles.select(
        F.col(run),
        F.col("circle_no"),
        F.col("x").alias("_ax"),
        F.col("y").alias("_ay"),
        F.col("radius").alias("_r"),
        F.col("color").alias("circle_color"),
    )
    return _covering(named, F.col("_ax"), F.col("_ay"), F.col("_r"), F.col("_r"))


def _celled_rectangles(rects: DataFrame, run: str) -> DataFrame:
    turn = F.radians(F.col("_t"))
    named = rects.select(
        F.col(run),
        F.col("rect_no"),
        F.col("x").alias("_ax"),
        F.col("y").alias("_ay"),
        F.col("half_w").alias("_w"),
        F.col("half_h").alias("_h"),
        F.col("angle_deg").cast("double").alias("_t"),
        F.col("color").alias("rect_color"),
    )
    ex = F.abs(F.col("_w") * F.cos(turn)) + F.abs(F.col("_h") * F.sin(turn))
    ey = F.abs(F.col("_w") * F.sin(turn)) + F.abs(F.col("_h") * F.cos(turn))
    return _covering(named, F.col("_ax"), F.col("_ay"), ex, ey)


def points_in_circles(points: DataFrame, circles: DataFrame, run: str) -> DataFrame:
    """One row per point and circle that holds it (edge included)."""
    joined = _meet(points, _celled_circles(circles, run), run)
    hit = in_circle(F.col("x"), F.col("y"), F.col("_ax"), F.col("_ay"), F.col("_r"))
    return joined.filter(hit).drop("_ax", "_ay", "_r")


def points_in_rects(points: DataFrame, rects: DataFrame, run: str) -> DataFrame:
    """One row per point and rectangle that holds it (edge excluded)."""
    joined = _meet(points, _celled_rectangles(rects, run), run)
    hit = in_rectangle(
        F.col("x"), F.col("y"), F.col("_ax"), F.col("_ay"), F.col("_w"), F.col("_h"), F.col("_t")
    )
    return joined.filter(hit).drop("_ax", "_ay", "_w", "_h", "_t")


def floor_color(
    points: DataFrame, circles: DataFrame, rects: DataFrame, run: str, key: list[str]
) -> DataFrame:
    """Floor colour under each point: black before white before gray.

    Both kinds of area share one table with a row per cell that holds the areas listed
    there, packed. A point looks up its cell in each grid in use and decides in its own row,
    so positions are not shuffled to bring matches together.
    """
    shades = F.when(F.col("_color") == "black", 0).when(F.col("_color") == "white", 1)
    null = F.lit(None).cast("double")
    round_ = _celled_circles(circles, run).select(
        run, *CELL, "_ax", "_ay", "_r", null.alias("_w"), null.alias("_h"),
        null.alias("_t"), F.col("circle_color").alias("_color"),
    )
    angular = _celled_rectangles(rects, run).select(
        run, *CELL, "_ax", "_ay", null.alias("_r"), "_w", "_h", "_t",
        F.col("rect_color").alias("_color"),
    )
    areas = round_.unionByName(angular).withColumn("_shade", shades).filter("_shade is not null")
    parts = ["_ax", "_ay", "_r", "_w", "_h", "_t", "_shade"]
    packed = pin(areas.groupBy(run, *CELL).agg(F.collect_list(F.struct(*parts)).alias("_areas")))
    x, y = F.col("x"), F.col("y")

    def shade(a: Column) -> Column:
        hit = F.when(a["_r"].isNotNull(), in_circle(x, y, a["_ax"], a["_ay"], a["_r"])).otherwise(
            in_rectangle(x, y, a["_ax"], a["_ay"], a["_w"], a["_h"], a["_t"])
        )
        return F.when(hit, a["_shade"])

    rows = points.select(run, *key, "x", "y")
    found = [F.lit(None).cast("int")]
    for n, level in enumerate(_levels(packed)):
        size = 2.0**level
        side = packed.filter(F.col("_level") == level).select(
            run, F.col("_cx").alias(f"_cx{n}"), F.col("_cy").alias(f"_cy{n}"), F.col("_areas").alias(f"_areas{n}")
        )
        rows = rows.withColumns({f"_cx{n}": _cell(x, size), f"_cy{n}": _cell(y, size)})
        rows = attach(rows, side, [run, f"_cx{n}", f"_cy{n}"])
        found.append(F.array_min(F.transform(f"_areas{n}", shade)))
    best = F.least(*found) if len(found) > 1 else found[0]
    best = F.when(_finite(x, y), best)
    color = F.when(best == 0, "black").when(best == 1, "white").otherwise("gray")
    return rows.select(run, *key, "x", "y", color.alias("color"))


#: Targets in a leaf of the tree, cuts of a box along each axis, and levels below the root.
LEAF, CUTS, LEVELS = 32, 4, 15
BOX = ["x0", "x1", "y0", "y1"]


def _boxes(targets: DataFrame, run: str) -> DataFrame:
    """One row per (run, node): its targets' number and bounding box."""
    ends = [f(c).alias(f"{c}{k}") for c in "xy" for k, f in enumerate((F.min, F.max))]
    return targets.groupBy(run, "node").agg(F.count(F.lit(1)).alias("n"), *ends)


def _tree(targets: DataFrame, run: str, leaf: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each level below the root (run, node, parent, leaf, box), and the targets
    with their leaf. A node of more than ``leaf`` targets is cut into equal cells of the bounding
    box of its own targets, so one far target costs one level and not one for each doubling."""
    levels, settled = [], []
    active = targets.withColumn("node", F.lit(1).cast("long"))
    for level in range(LEVELS + 1):
        active = pin(active)
        boxes = pin(_boxes(active, run))
        width = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
        ends = (F.col("n") <= leaf) | (width <= 0) if level < LEVELS else F.lit(True)
        boxes = boxes.withColumn("leaf", ends)
        parent = F.floor(F.col("node") / F.lit(CUTS * CUTS)).cast("long")
        levels.append(boxes.select(run, "node", parent.alias("parent"), "leaf", *BOX))
        placed = attach(active, boxes.select(run, "node", "leaf", *BOX), [run, "node"], how="inner")
        settled.append(placed.filter("leaf").select(*active.columns))

        def cut(c: str, low: str) -> Column:
            return F.least(F.floor((F.col(c) - F.col(low)) / width * CUTS), F.lit(CUTS - 1))

        child = F.col("node") * (CUTS * CUTS) + cut("x", "x0") * CUTS + cut("y", "y0")
        active = placed.filter(~F.col("leaf")).select(*targets.columns, child.cast("long").alias("node"))
        if boxes.filter(~F.col("leaf")).isEmpty():
            break
    return levels, reduce(DataFrame.unionByName, settled)


def nearest(
    points: DataFrame,
    targets: DataFrame,
    run: str,
    key: list[str],
    leaf: int = LEAF,
) -> DataFrame:
    """Nearest target of each point within its run; ties go to the lowest ``idx``.

    ``targets`` has (run, idx, x, y); (run, ``key``) names a point. The targets of each run form
    a tree of boxes whose leaves hold at most ``leaf`` of them. All points go down their trees at
    once: a level offers the children of the boxes a point still considers, the farthest corner of
    the best one bounds the distance, and boxes that begin beyond it are left out. What is
    compared with a point are the targets of the few leaves that are left, whatever the density
    of its own or other runs. Points of runs without a target, and points without finite
    coordinates, keep NULLs; such targets are no targets.
    """
    usable = targets.filter(_finite(F.col("x"), F.col("y")))
    merged = pin(usable.groupBy(run, "x", "y").agg(F.min("idx").alias("idx")))
    levels, leaves = _tree(merged, run, leaf)
    finite = _finite(F.col("x"), F.col("y"))
    names = [run, *key]

    def within(low: Column, value: Column, high: Column) -> Column:
        return F.greatest(low - value, value - high, F.lit(0.0))

    x, y = F.col("x"), F.col("y")
    box = [F.col(c) for c in BOX]
    begins = F.sqrt(F.pow(within(box[0], x, box[1]), 2) + F.pow(within(box[2], y, box[3]), 2))
    far = [F.greatest(F.abs(v - low), F.abs(high - v)) for v, low, high in ((x, *box[:2]), (y, *box[2:]))]
    ends = F.sqrt(far[0] * far[0] + far[1] * far[1])
    # rounding must not lose a target at the very bound
    near = F.col("begins") <= F.col("bound") * (1 + EDGE)
    open_ = points.filter(finite).select(*names, "x", "y", F.lit(0).cast("long").alias("_in"), F.lit(float("inf")).alias("bound"))
    found = []
    for nodes in levels:
        met = attach(open_, nodes.withColumnRenamed("parent", "_in"), [run, "_in"], how="inner").withColumn("begins", begins)
        best = F.min(F.least("bound", ends)).over(Window.partitionBy(*names))
        left = pin(met.filter(near).withColumn("bound", best).filter(near).select(*names, "x", "y", "node", "leaf", "begins", "bound"))
        found.append(left.filter("leaf").drop("leaf"))
        open_ = left.filter(~F.col("leaf")).select(*names, "x", "y", F.col("node").alias("_in"), "bound")
    # the last bound of a point is the best one
    pool = reduce(DataFrame.unionByName, found)
    pool = pool.withColumn("bound", F.min("bound").over(Window.partitionBy(*names))).filter(near)
    held = leaves.select(run, "node", "idx", F.col("x").alias("_tx"), F.col("y").alias("_ty"))
    pairs = attach(pool.select(*names, "x", "y", "node"), held, [run, "node"], how="inner")
    d = distance(x, y, F.col("_tx"), F.col("_ty"))
    best = pairs.groupBy(*names).agg(F.min(F.struct(d.alias("dist"), F.col("idx"))).alias("_best"))
    joined = points.join(best, names, "left")
    return joined.select(*points.columns, "_best.idx", "_best.dist")


def crowding(assigned: DataFrame, run: str, target: str) -> DataFrame:
    """Robots that share their target with at least one other, per run."""
    per_target = assigned.groupBy(run, target).agg(F.count(F.lit(1)).alias("_n"))
    shared = F.when(F.col("_n") >= 2, F.col("_n")).otherwise(F.lit(0))
    return per_target.groupBy(run).agg(F.sum(shared).alias("crowded"))


def bounding_box(points: DataFrame, by: list[str]) -> DataFrame:
    box = points.groupBy(*by).agg(
        F.min("x").alias("min_x"), F.max("x").alias("max_x"),
        F.min("y").alias("min_y"), F.max("y").alias("max_y"),
    )
    width, height = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    return (
        box.withColumn("area", width * height)
        .withColumn("center_x", (F.col("min_x") + F.col("max_x")) / 2.0)
        .withColumn("center_y", (F.col("min_y") + F.col("max_y")) / 2.0)
    )
