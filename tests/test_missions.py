"""Areas, nearest points, mission scores and tracks against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from trialbook.operators import attach as attach_module
from trialbook.operators import fitness, spatial, tracks

OBJECTIVE = (
    "run_id string, kind string, target_color string, conn_start string, conn_end string, "
    "connection_range double, area_w double, area_h double, source string, sink string"
)


def objective(spark, **fields):
    names = [f.split()[0] for f in OBJECTIVE.split(", ")]
    return spark.createDataFrame([tuple(fields.get(n) for n in names)], OBJECTIVE)


def ends(spark, points, tick=5):
    data = [("r", f"robot{i}", tick, float(x), float(y)) for i, (x, y) in enumerate(points)]
    early = [("r", f"robot{i}", 0, 9.0, 9.0) for i in range(len(points))]
    return spark.createDataFrame(data + early, "run_id string, robot_id string, tick int, x double, y double")


def circles(spark, *items):
    data = [("r", i, *map(float, c[:3]), c[3]) for i, c in enumerate(items)]
    return spark.createDataFrame(data, "run_id string, circle_no int, x double, y double, radius double, color string")


def test_aggregation(spark):
    places = ends(spark, [(-0.08, -0.35), (0.24, -0.35), (-0.03, 0.26), (0.6, 0.6)])
    floor = circles(spark, (-0.08, -0.35, 0.33, "black"), (-0.03, 0.26, 0.28, "white"))
    goal = objective(spark, run_id="r", kind="aggregation", target_color="black")
    assert rows(fitness.aggregation_fitness(places, floor, goal), "fitness") == [(0.5,)]
    none = objective(spark, run_id="r", kind="aggregation", target_color="red")
    assert rows(fitness.aggregation_fitness(places, floor, none), "fitness") == [(0.0,)]


def test_connection(spark):
    places = ends(spark, [(0, 0.1), (0.26, 0), (0.24, 0), (0.9, 0.2)])
    floor = circles(spark, (0, 0, 0.1, "black"), (1, 0, 0.1, "white"))
    goal = objective(spark, run_id="r", kind="connection", conn_start="black", conn_end="white", connection_range=0.25)
    assert rows(fitness.connection_fitness(places, floor, goal), "fitness")[0][0] == pytest.approx(-0.543607, abs=1e-6)


def test_connection_without_end_is_zero(spark):
    goal = objective(spark, run_id="r", kind="connection", conn_start="black", conn_end="white", connection_range=0.25)
    floor = circles(spark, (0, 0, 0.1, "black"))
    assert rows(fitness.connection_fitness(ends(spark, [(0, 0)]), floor, goal), "fitness") == [(0.0,)]


def test_distribution(spark):
    places = ends(spark, [(0, 0), (1, 0), (0, 1), (1, 1), (0.5, 0.6)])
    goal = objective(spark, run_id="r", kind="distribution", area_w=1.0, area_h=1.0, connection_range=0.5)
    assert rows(fitness.distribution_fitness(places, goal), "fitness")[0][0] == pytest.approx(-0.1)


def test_lattice_matches_search_over_all_points(spark):
    rng = random.Random(3)
    points = [(rng.uniform(-2, 2), rng.uniform(-1, 3)) for _ in range(80)]
    goal = objective(spark, run_id="r", kind="distribution", area_w=1.7, area_h=2.3, connection_range=0.31)
    got = dict((r, (p, d)) for r, p, d in rows(fitness.lattice_assignment(ends(spark, points), goal), "robot_id", "point", "dist"))
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    side = math.sqrt(1.7 * 2.3)
    x0, y0 = (min(xs) + max(xs)) / 2 - side / 2, (min(ys) + max(ys)) / 2 - side / 2
    m = int(side / 0.31 + 1e-9)
    lattice = [(x0 + i * 0.31, y0 + j * 0.31) for i in range(m + 1) for j in range(m + 1)]
    for i, (x, y) in enumerate(points):
        found = [math.hypot(x - a, y - b) for a, b in lattice]
        point, dist = got[f"robot{i}"]
        assert dist == pytest.approx(min(found)) and found[point] == pytest.approx(min(found))


def zone_rows(spark, zones):
    at = {"src": (0.0, 0.0), "sink": (4.0, 0.0), "none": (9.0, 9.0), "both": (2.0, 0.0)}
    data = [("r", "a", t, *at[z]) for t, z in enumerate(zones)]
    return spark.createDataFrame(data, "run_id string, robot_id string, tick int, x double, y double")


FORAGE = [(0.0, 0.0, 2.5, "black"), (4.0, 0.0, 2.5, "white")]


def test_foraging(spark):
    places = zone_rows(spark, ["src", "src", "both", "sink", "sink", "src", "none", "sink"])
    goal = objective(spark, run_id="r", kind="foraging", source="black", sink="white")
    floor = circles(spark, *FORAGE)
    assert rows(fitness.foraging_fitness(places, floor, goal), "fitness") == [(2.0,)]
    counters = rows(fitness.foraging_counters(places, floor, goal), "tick", "picked_up", "dropped", "on_source", "on_sink")
    assert counters == [(0, 1, 0, 1, 0), (1, 0, 0, 1, 0), (3, 0, 1, 0, 1), (4, 0, 0, 0, 1), (5, 1, 0, 1, 0), (7, 0, 1, 0, 1)]


def test_foraging_matches_a_carry_flag(spark):
    rng = random.Random(11)
    data, want = [], {}
    at = {"src": (0.0, 0.0), "sink": (4.0, 0.0), "none": (9.0, 9.0), "both": (2.0, 0.0)}
    for robot in range(6):
        ticks = 900 if robot == 0 else 60
        carry = count = 0
        for t in range(ticks):
            zone = rng.choice(list(at))
            data.append(("r", str(robot), t, *at[zone]))
            if zone == "src":
                carry = 1
            elif zone == "sink" and carry:
                carry, count = 0, count + 1
        want[str(robot)] = count
    rng.shuffle(data)
    places = spark.createDataFrame(data, "run_id string, robot_id string, tick int, x double, y double").repartition(4)
    goal = objective(spark, run_id="r", kind="foraging", source="black", sink="white")
    assert dict(rows(fitness.deliveries(places, circles(spark, *FORAGE), goal), "robot_id", "delivered")) == want


def test_circle_of_two_with_one_colour(spark):
    """The last circle of a colour seen up to where both colours are known counts."""
    floor = circles(spark, (0, 0, 1, "black"), (1, 0, 1, "black"), (2, 0, 1, "white"), (3, 0, 1, "black"))
    goal = objective(spark, run_id="r", kind="foraging", source="black", sink="white")
    pair = fitness.circle_pairs(floor, goal, "foraging", "source", "sink").first()
    assert (pair["first"]["x"], pair["second"]["x"]) == (1.0, 2.0)
    aim = objective(spark, run_id="r", kind="aggregation", target_color="black")
    assert fitness.target_circles(floor, aim).first()["target"]["x"] == 3.0


def test_unknown_kind_is_an_error(spark):
    goal = objective(spark, run_id="r", kind="dancing")
    with pytest.raises(Exception, match="objective not implemented: dancing"):
        fitness.fitness(ends(spark, [(0, 0)]), circles(spark, (0, 0, 1, "black")), goal).collect()


def corners_inside(px, py, cx, cy, w, h, angle):
    """Point in rectangle by its corners, as inner products with two sides."""
    phi, theta, hyp = math.atan(h / w), math.radians(angle), math.hypot(w, h)
    c1 = (cx - hyp * math.cos(phi + theta), cy + hyp * math.sin(phi + theta))
    c2 = (cx + hyp * math.cos(phi - theta), cy + hyp * math.sin(phi - theta))
    c3 = (cx + hyp * math.cos(phi + theta), cy - hyp * math.sin(phi + theta))
    inside = True
    for corner in (c1, c3):
        side = (corner[0] - c2[0], corner[1] - c2[1])
        along = (px - c2[0]) * side[0] + (py - c2[1]) * side[1]
        inside = inside and 0 < along < side[0] ** 2 + side[1] ** 2
    return inside


def test_large_areas_are_listed_under_few_cells(spark):
    discs = [("r", j, 10.0 * j, -7.0 * j, 500.0, "black") for j in range(3)]
    c = spark.createDataFrame(discs, "run_id string, circle_no int, x double, y double, radius double, color string")
    assert spatial._celled_circles(c, "run_id").count() <= 12
    p = spark.createDataFrame([("r", 1, 499.0, 0.0), ("r", 2, 501.0, 0.0), ("r", 3, None, 0.0), ("r", 4, float("nan"), 0.0)], "run_id string, i int, x double, y double")
    got = rows(spatial.points_in_circles(p, c, "run_id"), "i", "circle_no")
    assert got == [(1, 0), (1, 1), (1, 2), (2, 1), (2, 2)]


def test_many_areas_join_by_key(spark, monkeypatch):
    monkeypatch.setattr(attach_module, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        c = spark.range(2000).selectExpr("'r' AS run_id", "CAST(id AS INT) AS circle_no", "id * 1.0D AS x", "0.0D AS y", "0.4D AS radius", "'black' AS color")
        p = spark.range(2000).selectExpr("'r' AS run_id", "id AS i", "id * 1.0D AS x", "0.0D AS y")
        assert spatial.points_in_circles(p, c, "run_id").count() == 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rectangles_and_circles(spark):
    rng = random.Random(8)
    points = [("r", i, rng.uniform(-2, 2), rng.uniform(-2, 2)) for i in range(300)]
    rects = [("r", j, rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(0.2, 1), rng.uniform(0.2, 1), rng.uniform(0, 180), "white") for j in range(6)]
    discs = [("r", j, rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(0.1, 1), "black" if j % 2 else "white") for j in range(6)]
    p = spark.createDataFrame(points, "run_id string, i int, x double, y double")
    r = spark.createDataFrame(rects, "run_id string, rect_no int, x double, y double, half_w double, half_h double, angle_deg double, color string")
    c = spark.createDataFrame(discs, "run_id string, circle_no int, x double, y double, radius double, color string")
    in_rect = {(i, q[1]) for _, i, x, y in points for q in rects if corners_inside(x, y, *q[2:7])}
    in_disc = {(i, q[1]) for _, i, x, y in points for q in discs if math.hypot(x - q[2], y - q[3]) <= q[4]}
    assert set(rows(spatial.points_in_rects(p, r, "run_id"), "i", "rect_no")) == in_rect
    assert set(rows(spatial.points_in_circles(p, c, "run_id"), "i", "circle_no")) == in_disc
    color = {}
    for i in range(300):
        black = any(discs[j][5] == "black" for k, j in in_disc if k == i)
        white = any(discs[j][5] == "white" for k, j in in_disc if k == i) or any(k == i for k, _ in in_rect)
        color[i] = "black" if black else "white" if white else "gray"
    assert dict(rows(spatial.floor_color(p, c, r, "run_id", ["i"]), "i", "color")) == color


@pytest.mark.parametrize("leaf", [1, 4, 32])
def test_nearest(spark, leaf):
    rng = random.Random(4)
    points = [("r" if i % 3 else "s", i, rng.uniform(-9, 9), rng.uniform(-2, 2)) for i in range(150)] + [("lonely", 999, 0.0, 0.0), ("r", 998, None, 0.0), ("r", 997, 0.0, float("inf"))]
    targets = [("r" if j % 3 else "s", j, round(rng.uniform(-2, 2), 1), round(rng.uniform(-2, 2), 1)) for j in range(40)]
    # far away, and a crowd much closer together than the others
    targets += [("r", 500, None, 1.0), ("r", 501, 1e7, -1e7), ("s", 502, -1e9, 0.0)]
    targets += [("s", 600 + j, 1.0 + j * 1e-9, 1.0) for j in range(20)]
    targets += [(r, j + 100, x, y) for r, j, x, y in targets[:5]]
    p = spark.createDataFrame(points, "run_id string, i int, x double, y double")
    t = spark.createDataFrame(targets, "run_id string, idx int, x double, y double")
    got = {i: (idx, d) for i, idx, d in rows(spatial.nearest(p, t, "run_id", ["i"], leaf), "i", "idx", "dist")}
    assert got.pop(999) == got.pop(998) == got.pop(997) == (None, None)
    for run, i, x, y in points[:-3]:
        best = min((math.sqrt((x - a) ** 2 + (y - b) ** 2), j) for q, j, a, b in targets if q == run and a is not None)
        assert got[i][0] == best[1] and got[i][1] == pytest.approx(best[0])


@pytest.mark.parametrize("chunk_rows", [1, 7, 100_000])
def test_tracks_over_stretches(spark, chunk_rows):
    rng = random.Random(11)
    data = [
        (clip, frame, det, rng.uniform(0, 90), rng.uniform(0, 30))
        for clip, frames in (("a", 40), ("b", 3), ("c", 25))
        for frame in range(frames)
        for det in range(rng.randint(1, 6))
        if not (clip == "c" and frame == 17)
    ]
    got = rows(tracks.link_tracks(spark.createDataFrame(data, "clip string, frame long, det int, x double, y double"), chunk_rows=chunk_rows), "clip", "frame", "det")
    want = []
    for clip in "abc":
        at = next((r for r in data if r[:3] == (clip, 0, 0)), None)
        while at:
            near = [(math.hypot(r[3] - at[3], r[4] - at[4]), r) for r in data if r[0] == clip and r[1] == at[1] + 1]
            near = [x for x in near if x[0] < 50.0]
            at = min(near, key=lambda x: (x[0], x[1][2]))[1] if near else None
            if at:
                want.append(at[:3])
    assert got == sorted(want)


def test_track(spark):
    data = [("c", 0, 0, 0, 0), ("c", 1, 0, 10, 0), ("c", 1, 1, 30, 0), ("c", 2, 0, 80, 0), ("c", 3, 0, 12, 0)]
    df = spark.createDataFrame([(c, f, d, float(x), float(y)) for c, f, d, x, y in data], "clip string, frame int, det int, x double, y double")
    assert rows(tracks.link_tracks(df), "frame", "x") == [(1, 10.0)]


def test_tracks_match_a_walk(spark):
    rng = random.Random(6)
    data = [(f"clip{c}", f, d, float(rng.randint(0, 90)), float(rng.randint(0, 90)))
            for c in range(4) for f in range(40 if c else 75) for d in range(rng.randint(3, 7))]
    df = spark.createDataFrame(data, "clip string, frame int, det int, x double, y double").repartition(4)
    want = []
    for clip in sorted({r[0] for r in data}):
        frames = {}
        for c, f, d, x, y in data:
            if c == clip:
                frames.setdefault(f, []).append((d, x, y))
        at, f = next(q for q in frames[0] if q[0] == 1)[1:], 1
        while f in frames:
            near = [(math.sqrt((x - at[0]) ** 2 + (y - at[1]) ** 2), d, x, y) for d, x, y in frames[f]]
            near = [q for q in near if q[0] < 60]
            if not near:
                break
            _, d, x, y = min(near)
            want.append((clip, f, d))
            at, f = (x, y), f + 1
    got = rows(tracks.link_tracks(df, index=1, max_dist=60.0), "clip", "frame", "det")
    assert got == sorted(want) and len(got) > 60


def test_motion_trace(spark):
    values = [0, 50, 60, 100, 100]
    df = spark.createDataFrame([("c", 1, i, float(x)) for i, x in enumerate(values)], "clip string, cell int, frame int, v double")
    got = tracks.motion_trace(df, "clip", "cell", "frame", "v").first()["trace"]
    assert got == pytest.approx(39.180985, abs=1e-6)


def test_every_nth(spark):
    df = spark.range(95).select("id", (F.col("id") % 2).alias("g"))
    assert rows(tracks.every_nth(df, ["g"], ["id"]), "id") == [(i,) for i in range(95) if (i // 2 + 1) % 10 == 0]
