"""Queries over joins, positions, splits, preference data, tracks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialbook.operators import combine, fitness, hooks, preferences, spatial, splits, tracks
from trialbook.plans import views as v
from trialbook.plans.registry import query, stable, stable_sql as r, with_stable
from trialbook.session import literal_table, pin

# --- joins -------------------------------------------------------------------------------


@query("attach_controllers", f"""
WITH {v.SCORED}, {v.CONTROLLERS}
SELECT s.scenario_id, type, behavior_tree FROM scored s LEFT JOIN controllers c ON c.scenario_id = s.scenario_id""")
def attach_controllers(spark, folder):
    rows = v.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("scenario_id"), F.col("o_orderpriority").alias("type")
    )
    return combine.attach_controllers(rows, v.controllers(spark, folder))


def _two_experiments(spark, folder):
    """Two experiments over the same scenarios."""
    rows = pin(v.scored(spark, folder))
    formal = rows.select("scenario_id", "type", F.col("avg_score").alias("score"))
    control = rows.select("scenario_id", "type", F.col("llm_avg_score").alias("score"))
    return formal, control


@query("paired_experiments", f"""
WITH {v.SCORED}
SELECT scenario_id, type AS type_formal, avg_score AS score_formal, type AS type_control, llm_avg_score AS score_control FROM scored""")
def paired_experiments(spark, folder):
    return combine.paired_experiments(*_two_experiments(spark, folder), "scenario_id")


@query("paired_unequal", f"""
WITH {v.SCORED}, c AS (SELECT * FROM scored WHERE scenario_id <> (SELECT max(scenario_id) FROM scored)),
both_same AS (SELECT (SELECT count(*) FROM scored) = (SELECT count(*) FROM c) AS same)
SELECT 'equal' AS experiments, count(*) AS n, count(llm_avg_score) AS scored FROM scored
UNION ALL SELECT 'one key short', count(*), count(llm_avg_score) FROM c, both_same WHERE same""")
def paired_unequal(spark, folder):
    """Experiments over the same scenarios give their pairs; with one scenario missing they give none."""
    formal, control = _two_experiments(spark, folder)
    short = control.join(control.agg(F.max("scenario_id").alias("scenario_id")), "scenario_id", "left_anti")

    def counted(name, other):
        pairs = combine.paired_experiments(formal, other, "scenario_id")
        return pairs.agg(F.count(F.lit(1)).alias("n"), F.count("score_control").alias("scored")).withColumn("experiments", F.lit(name))

    return counted("equal", control).unionByName(counted("one key short", short))


@query("key_set_equal", """
SELECT (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS only_left,
  (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS only_right,
  (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS in_both,
  (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) = 0
  AND (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) = 0 AS equal""")
def key_set_equal(spark, folder):
    orders = v.table(spark, folder, "orders").select(F.col("o_orderkey").alias("scenario_id"))
    lines = v.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("scenario_id"))
    return combine.key_sets(orders, lines, "scenario_id")


@query("zip_join", f"""
WITH {v.SCORED}, a AS (SELECT row_number() OVER (ORDER BY scenario_id) AS row_no, llm_avg_score AS transfer FROM scored WHERE type = '1-URGENT'),
b AS (SELECT row_number() OVER (ORDER BY scenario_id) AS row_no, llm_avg_score AS train, type FROM scored WHERE type = '5-LOW')
SELECT a.row_no, transfer, train, type FROM a JOIN b ON a.row_no = b.row_no""")
def zip_join(spark, folder):
    rows = v.scored(spark, folder)
    a = rows.filter("type = '1-URGENT'").select(
        F.col("scenario_id").alias("_a"), F.col("llm_avg_score").alias("transfer")
    )
    b = rows.filter("type = '5-LOW'").select(
        F.col("scenario_id").alias("_b"), F.col("llm_avg_score").alias("train"), "type"
    )
    return combine.zip_rows(a, b, ["_a"], ["_b"]).drop("_a", "_b")


@query("fixed_controller", """
SELECT o_orderkey AS scenario_id, o_orderpriority AS type, CASE o_orderpriority
  WHEN '1-URGENT' THEN '--nroot 3 --nchildroot 1' WHEN '2-HIGH' THEN '--nroot 3 --nchildroot 2' END AS controller FROM orders""")
def fixed_controller(spark, folder):
    chosen = literal_table(
        spark,
        [
            {"type": "1-URGENT", "controller": "--nroot 3 --nchildroot 1"},
            {"type": "2-HIGH", "controller": "--nroot 3 --nchildroot 2"},
        ],
        "type: string, controller: string",
    )
    rows = v.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("scenario_id"), F.col("o_orderpriority").alias("type")
    )
    return combine.fixed_controller(rows, chosen)


# --- positions ------------------------------------------------------------------------------

_IN_CIRCLE = "sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) <= c.radius"
_IN_RECT = """abs((p.x - c.x) * cos(radians(angle_deg)) - (p.y - c.y) * sin(radians(angle_deg))) < half_w
  AND abs((p.x - c.x) * sin(radians(angle_deg)) + (p.y - c.y) * cos(radians(angle_deg))) < half_h"""


@query("point_in_circle", f"""
WITH {v.POSITIONS}, {v.CIRCLES}
SELECT p.run_id, p.robot_id, p.tick, c.circle_no, c.color AS circle_color FROM positions p JOIN circles c ON c.run_id = p.run_id AND {_IN_CIRCLE}""")
def point_in_circle(spark, folder):
    hits = spatial.points_in_circles(
        v.robot_positions(spark, folder), v.floor_circles(spark, folder), "run_id"
    )
    return hits.select("run_id", "robot_id", "tick", "circle_no", "circle_color")


@query("point_in_rect", f"""
WITH {v.POSITIONS}, {v.RECTANGLES}
SELECT p.run_id, p.robot_id, p.tick, c.rect_no, c.color AS rect_color FROM positions p JOIN rects c ON c.run_id = p.run_id AND {_IN_RECT}""")
def point_in_rect(spark, folder):
    hits = spatial.points_in_rects(
        v.robot_positions(spark, folder), v.floor_rectangles(spark, folder), "run_id"
    )
    return hits.select("run_id", "robot_id", "tick", "rect_no", "rect_color")


@query("floor_color", f"""
WITH {v.POSITIONS}, {v.CIRCLES}, {v.RECTANGLES}, hits AS (
  SELECT p.run_id, p.tick, c.color FROM positions p JOIN circles c ON c.run_id = p.run_id AND {_IN_CIRCLE}
  UNION ALL SELECT p.run_id, p.tick, c.color FROM positions p JOIN rects c ON c.run_id = p.run_id AND {_IN_RECT}),
s AS (SELECT run_id, tick, bool_or(color = 'black') AS b, bool_or(color = 'white') AS w FROM hits GROUP BY 1, 2)
SELECT p.run_id, p.robot_id, p.tick, CASE WHEN b THEN 'black' WHEN w THEN 'white' ELSE 'gray' END AS color
FROM positions p LEFT JOIN s ON s.run_id = p.run_id AND s.tick = p.tick""")
def floor_color(spark, folder):
    colored = spatial.floor_color(
        v.robot_positions(spark, folder),
        v.floor_circles(spark, folder),
        v.floor_rectangles(spark, folder),
        "run_id",
        ["robot_id", "tick"],
    )
    return colored.select("run_id", "robot_id", "tick", "color")


@query("nearest_point", f"""
WITH {v.POSITIONS}, {v.CIRCLES}, d AS (
  SELECT p.run_id, p.robot_id, p.tick, c.circle_no AS idx, sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) AS dist
  FROM positions p JOIN circles c ON c.run_id = p.run_id),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id, robot_id, tick ORDER BY dist, idx) AS i FROM d)
SELECT run_id, robot_id, tick, CASE WHEN tick % 13 <> 0 THEN idx END AS idx, CASE WHEN tick % 13 <> 0 THEN {r('dist')} END AS dist
FROM k WHERE i = 1""")
def nearest_point(spark, folder):
    """Every 13th position has lost a coordinate."""
    targets = v.floor_circles(spark, folder).select("run_id", F.col("circle_no").alias("idx"), "x", "y")
    places = v.robot_positions(spark, folder).withColumn("x", F.when(F.col("tick") % 13 != 0, F.col("x")))
    near = spatial.nearest(places, targets, "run_id", ["robot_id", "tick"])
    return near.select("run_id", "robot_id", "tick", "idx", stable("dist").alias("dist"))


@query("nearest_uneven", f"""
WITH {v.POSITIONS}, {v.CIRCLES}, t AS (
  SELECT run_id, circle_no AS idx, x, y FROM circles
  UNION ALL SELECT run_id, circle_no + 100, x + 1000000, y - 1000000 FROM circles WHERE length(run_id) % 2 = 0
  UNION ALL SELECT run_id, circle_no + 200, x + 0.0009765625, y FROM circles WHERE ascii(right(run_id, 1)) % 3 = 0),
d AS (SELECT p.run_id, robot_id, tick, idx, sqrt((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y)) AS dist
  FROM positions p JOIN t ON t.run_id = p.run_id),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id, robot_id, tick ORDER BY dist, idx) AS i FROM d)
SELECT run_id, robot_id, tick, idx, {r('dist')} AS dist FROM k WHERE i = 1""")
def nearest_uneven(spark, folder):
    """Runs with targets far from all others beside runs with crowded ones."""
    own = v.floor_circles(spark, folder).select("run_id", F.col("circle_no").alias("idx"), "x", "y")
    moved = own.select("run_id", F.col("idx") + 100, F.col("x") + 1_000_000, F.col("y") - 1_000_000).filter("length(run_id) % 2 = 0")
    beside = own.select("run_id", F.col("idx") + 200, F.col("x") + 0.0009765625, "y").filter("ascii(right(run_id, 1)) % 3 = 0")
    near = spatial.nearest(v.robot_positions(spark, folder), own.union(moved).union(beside), "run_id", ["robot_id", "tick"], leaf=4)
    return near.select("run_id", "robot_id", "tick", "idx", stable("dist").alias("dist"))


@query("bounding_box", f"""
WITH {v.POSITIONS}
SELECT run_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y,
  {r('(max(x) - min(x)) * (max(y) - min(y))')} AS area, {r('(min(x) + max(x)) / 2')} AS center_x,
  {r('(min(y) + max(y)) / 2')} AS center_y FROM positions GROUP BY 1""")
def bounding_box(spark, folder):
    box = spatial.bounding_box(v.robot_positions(spark, folder), ["run_id"])
    return with_stable(box, ["area", "center_x", "center_y"])


_LAST = "ends AS (SELECT run_id, robot_id, arg_max(x, tick) AS x, arg_max(y, tick) AS y FROM positions GROUP BY 1, 2)"


def _pair_sql(name: str, kind: str, a: str, b: str) -> str:
    """The circles of two colours per run, as SQL: the last of each up to where both are known."""
    return f"""{name}_l AS (
  SELECT c.*, c.color = o.{a} AS is_a, c.color = o.{b} AND c.color <> o.{a} AS is_b
  FROM circles c JOIN objectives o ON o.run_id = c.run_id WHERE o.kind = '{kind}'),
{name}_s AS (SELECT run_id, greatest(min(CASE WHEN is_a THEN circle_no END), min(CASE WHEN is_b THEN circle_no END)) AS stop,
    count(CASE WHEN is_a THEN 1 END) > 0 AND count(CASE WHEN is_b THEN 1 END) > 0 AS both_known FROM {name}_l GROUP BY 1),
{name} AS (SELECT l.run_id,
    arg_max(x, circle_no) FILTER (is_a) AS ax, arg_max(y, circle_no) FILTER (is_a) AS ay, arg_max(radius, circle_no) FILTER (is_a) AS ar,
    arg_max(x, circle_no) FILTER (is_b) AS bx, arg_max(y, circle_no) FILTER (is_b) AS by_, arg_max(radius, circle_no) FILTER (is_b) AS br
  FROM {name}_l l JOIN {name}_s s ON s.run_id = l.run_id WHERE both_known AND circle_no <= stop GROUP BY 1)"""


_AGGREGATION = f"""target AS (
  SELECT c.run_id, arg_max(x, circle_no) AS tx, arg_max(y, circle_no) AS ty, arg_max(radius, circle_no) AS tr
  FROM circles c JOIN objectives o ON o.run_id = c.run_id WHERE o.kind = 'aggregation' AND c.color = o.target_color GROUP BY 1),
agg_fit AS (
  SELECT o.run_id, o.kind, coalesce(avg(CASE WHEN sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)) <= tr THEN 1.0 ELSE 0.0 END)
    FILTER (tx IS NOT NULL AND x IS NOT NULL), 0) AS fitness
  FROM objectives o LEFT JOIN target t ON t.run_id = o.run_id LEFT JOIN ends e ON e.run_id = o.run_id
  WHERE o.kind = 'aggregation' GROUP BY 1, 2)"""

_CONNECTION = f"""{_pair_sql('line', 'connection', 'conn_start', 'conn_end')},
line_n AS (SELECT l.*, greatest(CAST(floor(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) / connection_range) AS BIGINT), 1) AS n
  FROM line l JOIN objectives o ON o.run_id = l.run_id),
line_p AS (SELECT run_id, i AS point, ax + i / n * (bx - ax) AS px, ay + i / n * (by_ - ay) AS py
  FROM line_n, unnest(range(n + 1)) t(i)),
line_k AS (SELECT e.run_id, robot_id, point, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS d,
    row_number() OVER (PARTITION BY e.run_id, robot_id ORDER BY sqrt((x - px) * (x - px) + (y - py) * (y - py)), point) AS k
  FROM ends e JOIN line_p p ON p.run_id = e.run_id),
line_c AS (SELECT run_id, point, count(*) AS n, sum(d) AS d FROM line_k WHERE k = 1 GROUP BY 1, 2),
con_fit AS (SELECT o.run_id, o.kind, coalesce(-sum(d) - sum(CASE WHEN n >= 2 THEN n ELSE 0 END) / 10.0, 0) AS fitness
  FROM objectives o LEFT JOIN line_c c ON c.run_id = o.run_id WHERE o.kind = 'connection' GROUP BY 1, 2)"""

_DISTRIBUTION = """box AS (SELECT e.run_id, (min(x) + max(x)) / 2.0 - sqrt(any_value(area_w * area_h)) / 2.0 AS x0,
    (min(y) + max(y)) / 2.0 - sqrt(any_value(area_w * area_h)) / 2.0 AS y0, any_value(connection_range) AS step,
    CAST(floor(sqrt(any_value(area_w * area_h)) / any_value(connection_range) + 1e-9) AS BIGINT) AS m
  FROM ends e JOIN objectives o ON o.run_id = e.run_id WHERE o.kind = 'distribution' GROUP BY 1),
lat_p AS (SELECT run_id, i * (m + 1) + j AS point, x0 + i * step AS px, y0 + j * step AS py
  FROM box, unnest(range(m + 1)) a(i), unnest(range(m + 1)) b(j)),
lat_k AS (SELECT e.run_id, robot_id, point, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS d,
    row_number() OVER (PARTITION BY e.run_id, robot_id ORDER BY round(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 9), point) AS k
  FROM ends e JOIN lat_p p ON p.run_id = e.run_id),
lat_c AS (SELECT run_id, point, count(*) AS n, sum(d) AS d FROM lat_k WHERE k = 1 GROUP BY 1, 2),
dis_fit AS (SELECT o.run_id, o.kind, coalesce(-sum(CASE WHEN n >= 2 THEN n ELSE 0 END) - sum(d), 0) AS fitness
  FROM objectives o LEFT JOIN lat_c c ON c.run_id = o.run_id WHERE o.kind = 'distribution' GROUP BY 1, 2)"""

_VISITS = f"""{_pair_sql('pair', 'foraging', 'source', 'sink')},
zones AS (SELECT p.run_id, robot_id, tick,
    sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)) <= ar AS on_a, sqrt((x - bx) * (x - bx) + (y - by_) * (y - by_)) <= br AS on_b
  FROM positions p JOIN pair q ON q.run_id = p.run_id),
kept AS (SELECT run_id, robot_id, tick, CASE WHEN on_a THEN 'source' ELSE 'sink' END AS zone FROM zones WHERE on_a <> on_b),
visits AS (SELECT *, lag(zone) OVER (PARTITION BY run_id, robot_id ORDER BY tick) AS prev FROM kept)"""
_DROPPED = "CAST(sum(CASE WHEN zone = 'sink' AND prev = 'source' THEN 1 ELSE 0 END) AS BIGINT)"

_FORAGING = f"""{_VISITS},
for_fit AS (SELECT o.run_id, o.kind, CAST(coalesce(sum(CASE WHEN zone = 'sink' AND prev = 'source' THEN 1 ELSE 0 END), 0) AS DOUBLE) AS fitness
  FROM objectives o LEFT JOIN visits s ON s.run_id = o.run_id WHERE o.kind = 'foraging' GROUP BY 1, 2)"""


@query("fitness_aggregation", f"WITH {v.ARENA}, {_LAST}, {_AGGREGATION} SELECT run_id, kind, {r('fitness')} AS fitness FROM agg_fit")
def fitness_aggregation(spark, folder):
    return with_stable(fitness.aggregation_fitness(*v.arena(spark, folder)), ["fitness"])


@query("fitness_connection", f"WITH {v.ARENA}, {_LAST}, {_CONNECTION} SELECT run_id, kind, {r('fitness')} AS fitness FROM con_fit")
def fitness_connection(spark, folder):
    return with_stable(fitness.connection_fitness(*v.arena(spark, folder)), ["fitness"])


@query("fitness_distribution", f"WITH {v.ARENA}, {_LAST}, {_DISTRIBUTION} SELECT run_id, kind, {r('fitness')} AS fitness FROM dis_fit")
def fitness_distribution(spark, folder):
    places, _, goals = v.arena(spark, folder)
    return with_stable(fitness.distribution_fitness(places, goals), ["fitness"])


@query("fitness_foraging", f"WITH {v.ARENA}, {_FORAGING} SELECT run_id, kind, fitness FROM for_fit")
def fitness_foraging(spark, folder):
    return fitness.foraging_fitness(*v.arena(spark, folder))


@query("fitness_all", f"""
WITH {v.ARENA}, {_LAST}, {_AGGREGATION}, {_CONNECTION}, {_DISTRIBUTION}, {_FORAGING}
SELECT run_id, kind, {r('fitness')} AS fitness FROM (
  SELECT * FROM agg_fit UNION ALL SELECT * FROM con_fit UNION ALL SELECT * FROM dis_fit UNION ALL SELECT * FROM for_fit)""")
def fitness_all(spark, folder):
    return with_stable(fitness.fitness(*v.arena(spark, folder)), ["fitness"])


@query("crowding", f"""
WITH {v.ARENA}, {_LAST}, {_DISTRIBUTION}
SELECT run_id, CAST(sum(CASE WHEN n >= 2 THEN n ELSE 0 END) AS BIGINT) AS crowded FROM lat_c GROUP BY 1""")
def crowding(spark, folder):
    places, _, goals = v.arena(spark, folder)
    return spatial.crowding(fitness.lattice_assignment(places, goals), "run_id", "point")


@query("deliveries", f"""
WITH {v.ARENA}, {_VISITS} SELECT run_id, robot_id, {_DROPPED} AS delivered FROM visits GROUP BY 1, 2""")
def deliveries(spark, folder):
    return fitness.deliveries(*v.arena(spark, folder))


@query("forage_counters", f"""
WITH {v.ARENA}, {_VISITS}
SELECT run_id, tick, CAST(sum(CASE WHEN zone = 'source' AND coalesce(prev, '') <> 'source' THEN 1 ELSE 0 END) AS BIGINT) AS picked_up,
  {_DROPPED} AS dropped, count(CASE WHEN zone = 'source' THEN 1 END) AS on_source, count(CASE WHEN zone = 'sink' THEN 1 END) AS on_sink
FROM visits GROUP BY 1, 2""")
def forage_counters(spark, folder):
    return fitness.foraging_counters(*v.arena(spark, folder))


# --- splits ------------------------------------------------------------------------------------

_DRAWN = f"""{v.COMPLETE}, drawn AS (
  SELECT *, row_number() OVER (ORDER BY md5('42:' || scenario_id), scenario_id) AS pos, count(*) OVER () AS n FROM complete)"""


@query("shuffle", f"WITH {_DRAWN} SELECT scenario_id, pos FROM drawn")
def shuffle(spark, folder):
    return splits.shuffled(v.scored(spark, folder), "scenario_id").select("scenario_id", "pos")


@query("holdout_split", f"""
WITH {_DRAWN} SELECT scenario_id, CASE WHEN pos <= 250 THEN 'validation' ELSE 'train' END AS split FROM drawn WHERE pos <= 2500""")
def holdout_split(spark, folder):
    return splits.holdout(v.complete(spark, folder).select("scenario_id"), "scenario_id").select("scenario_id", "split")


@query("train_val_split", f"""
WITH {_DRAWN} SELECT scenario_id, CASE WHEN pos <= ceil(n * 0.2) THEN 'validation' ELSE 'train' END AS split FROM drawn""")
def train_val_split(spark, folder):
    return splits.train_validation(v.complete(spark, folder).select("scenario_id"), "scenario_id").select("scenario_id", "split")


@query("size_ladder", f"""
WITH {_DRAWN} SELECT scenario_id, min(k) AS rung FROM drawn, range(1, 11) t(k) WHERE pos <= n * k // 10 GROUP BY 1""")
def size_ladder(spark, folder):
    return splits.size_ladder(v.complete(spark, folder).select("scenario_id"), "scenario_id").select("scenario_id", "rung")


@query("ladder_sizes", f"""
WITH {_DRAWN} SELECT k AS step, count(*) AS size FROM drawn, range(1, 11) t(k) WHERE pos <= n * k // 10 GROUP BY 1""")
def ladder_sizes(spark, folder):
    ladder = splits.size_ladder(v.complete(spark, folder).select("scenario_id"), "scenario_id")
    return splits.ladder_sizes(ladder)


def _drawn_where(condition: str, k: int) -> str:
    return f"""WITH {v.COMPLETE}, d AS (
  SELECT scenario_id, row_number() OVER (ORDER BY md5('42:' || scenario_id), scenario_id) AS pos FROM complete WHERE {condition})
SELECT scenario_id FROM d WHERE pos <= {k}"""


def _draw(spark, folder, condition, k):
    rows = splits.attribute_split(v.complete(spark, folder), condition, "scenario_id", k)
    return rows.select("scenario_id")


@query("split_color", _drawn_where("lightstype = 'F'", 450))
def split_color(spark, folder):
    return _draw(spark, folder, F.col("lightstype") == "F", 450)


@query("split_guided", _drawn_where("lightstype <> 'O'", 1250))
def split_guided(spark, folder):
    return _draw(spark, folder, F.col("lightstype") != "O", 1250)


@query("split_control", _drawn_where("true", 450))
def split_control(spark, folder):
    return _draw(spark, folder, F.lit(True), 450)


@query("split_loo", f"""
WITH {v.SCORED} SELECT scenario_id, CASE WHEN type = '3-MEDIUM' THEN 'held_out' ELSE 'rest' END AS split FROM scored""")
def split_loo(spark, folder):
    return splits.leave_one_out(v.scored(spark, folder), "type", "3-MEDIUM").select("scenario_id", "split")


@query("first_k", f"WITH {v.SCORED} SELECT scenario_id, avg_score FROM scored ORDER BY scenario_id LIMIT 450")
def first_k(spark, folder):
    rows = v.scored(spark, folder).select("scenario_id", "avg_score")
    return splits.first_k(rows, [F.col("scenario_id")], 450)


@query("row_slice", """
SELECT o_orderkey AS scenario_id FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 250""")
def row_slice(spark, folder):
    rows = v.table(spark, folder, "orders").select(F.col("o_orderkey").alias("scenario_id"))
    return splits.row_slice(rows, ["scenario_id"], 250, 500)


@query("pick_one", """
SELECT p_partkey, [p_name, p_type, p_brand][1 + CAST(('0x' || substr(md5('42:' || p_partkey), 1, 8)) AS BIGINT) % 3] AS description FROM part""")
def pick_one(spark, folder):
    variants = F.array("p_name", "p_type", "p_brand")
    return v.table(spark, folder, "part").select(
        "p_partkey", splits.pick_one(variants, F.col("p_partkey")).alias("description")
    )


# --- preference data --------------------------------------------------------------------------------

_PICKED = """scenario_id, CASE WHEN {a} > {b} THEN llmout_A ELSE llmout_B END AS win,
  CASE WHEN {a} > {b} THEN llmout_B ELSE llmout_A END AS lose,
  CASE WHEN {a} > {b} THEN {a} ELSE {b} END AS score_chosen, CASE WHEN {a} > {b} THEN {b} ELSE {a} END AS score_rejected"""


def _pair_text(name: str) -> str:
    from trialbook.functions.texts import SHORT_INSTRUCTION

    return f"'<s>[INST] ' || llmin || '{SHORT_INSTRUCTION}' || ' [/INST] ' || {name} || '</s>'"


@query("preference_pairs", f"""
WITH {v.JUDGED}, k AS (SELECT llmin, {_PICKED.format(a='scores_bt1', b='scores_bt2')} FROM judged)
SELECT scenario_id, {_pair_text('win')} AS chosen, {_pair_text('lose')} AS rejected, score_chosen, score_rejected FROM k""")
def preference_pairs(spark, folder):
    pairs = preferences.preference_pairs(
        v.judged(spark, folder), score_a="scores_bt1", score_b="scores_bt2"
    )
    return pairs.drop("type")


@query("best_of_two", f"""
WITH {v.JUDGED}, k AS (SELECT {_PICKED.format(a='scores_bt1', b='scores_bt2')}, scores_bt1, scores_bt2 FROM judged)
SELECT scenario_id, score_rejected AS avg_score, lose AS behavior_tree, score_chosen AS llm_avg_score, win AS llm_behavior_tree,
  scores_bt1 AS score_0, scores_bt2 AS score_1 FROM k""")
def best_of_two(spark, folder):
    out = preferences.best_of_two(v.judged(spark, folder))
    return out.select(
        "scenario_id", "avg_score", "behavior_tree", "llm_avg_score", "llm_behavior_tree",
        F.get("scores", F.lit(0)).alias("score_0"), F.get("scores", F.lit(1)).alias("score_1"),
    )


_SCALED_PAIRS = f"""{v.JUDGED}, b AS (
  SELECT type, least(min(scores_bt1), min(scores_bt2)) AS lo, greatest(max(scores_bt1), max(scores_bt2)) AS hi FROM judged GROUP BY 1),
sp AS (SELECT scenario_id, llmin, llmout_A, llmout_B, (scores_bt1 - lo) / nullif(hi - lo, 0) AS a, (scores_bt2 - lo) / nullif(hi - lo, 0) AS b
  FROM judged j JOIN b ON b.type = j.type WHERE scores_bt2 IS NOT NULL AND hi > lo)"""


@query("rl_pairs", f"""
WITH {_SCALED_PAIRS} SELECT scenario_id, llmout_A, llmout_B, {r('a')} AS scores_A, {r('b')} AS scores_B FROM sp""")
def rl_pairs(spark, folder):
    pairs = preferences.scaled_pairs(
        v.judged(spark, folder), "type", "scores_bt1", "scores_bt2", "llmout_A", "llmout_B", "llmin"
    )
    return with_stable(
        pairs.select("scenario_id", "llmout_A", "llmout_B", "scores_A", "scores_B"), ["scores_A", "scores_B"]
    )


@query("ft_pairs", f"""
WITH {_SCALED_PAIRS}, k AS (SELECT llmin, {_PICKED.format(a='a', b='b')} FROM sp)
SELECT scenario_id, {_pair_text('win')} AS chosen, {_pair_text('lose')} AS rejected,
  {r('score_chosen')} AS score_chosen, {r('score_rejected')} AS score_rejected FROM k""")
def ft_pairs(spark, folder):
    scaled = preferences.scaled_pairs(
        v.judged(spark, folder), "type", "scores_bt1", "scores_bt2", "llmout_A", "llmout_B", "llmin"
    )
    pairs = preferences.preference_pairs(scaled).select(
        "scenario_id", "chosen", "rejected", "score_chosen", "score_rejected"
    )
    return with_stable(pairs, ["score_chosen", "score_rejected"])


@query("sft_prepare", f"""
WITH {v.ARRAYS}, n AS (SELECT *, row_number() OVER (ORDER BY scenario_id) - 1 AS original_index FROM arrays),
k AS (SELECT * FROM n WHERE len(s) > 0),
u AS (SELECT scenario_id, unnest(list_transform(s, lambda x: x + abs(list_min(s)) + 1)) AS x FROM k),
c AS (SELECT scenario_id, {r('stddev_pop(x) / avg(x)')} AS coeff_of_var, {r('(max(x) - avg(x)) / nullif(stddev_pop(x), 0)')} AS top_z FROM u GROUP BY 1)
SELECT k.scenario_id, original_index, type AS llmin, lightstype AS llmout, coeff_of_var, top_z FROM k JOIN c ON c.scenario_id = k.scenario_id""")
def sft_prepare(spark, folder):
    out = preferences.sft_table(
        v.scored_arrays(spark, folder), "scenario_id", "scores", "type", "lightstype"
    )
    return out.select(
        "scenario_id", "original_index", "llmin", "llmout",
        stable("coeff_of_var").alias("coeff_of_var"),
        stable(F.array_max("z_scores")).alias("top_z"),
    )


# --- hooks --------------------------------------------------------------------------------------------


def _reverse_words():
    return lambda texts: texts.str.split(" ").map(lambda words: " ".join(words[::-1]), na_action="ignore")


@query("map_generate", f"""
WITH {v.DIALOG} SELECT conv_id, turn, array_to_string(list_reverse(string_split(llmin, ' ')), ' ') AS generated FROM dialog""")
def map_generate(spark, folder):
    rows = v.dialog(spark, folder).select("conv_id", "turn", "llmin")
    return hooks.map_generate(rows, _reverse_words, "llmin", "generated").drop("llmin")


def _stub_scorer():
    def score(batch, repeat):
        value = (batch["scenario_id"] % 97 + repeat) / 8.0
        return value.where((batch["scenario_id"] + repeat) % 4 != 0)

    return score


@query("map_score", f"""
WITH {v.CONTROLLERS}, k AS (
  SELECT scenario_id, CASE WHEN (scenario_id + i) % 4 <> 0 THEN (scenario_id % 97 + i) / 8.0 END AS s
  FROM controllers, range(10) t(i) WHERE behavior_tree <> '')
SELECT scenario_id, count(s) AS n_scores, {r('avg(s)')} AS avg_score FROM k GROUP BY 1""")
def map_score(spark, folder):
    runs = hooks.map_score(
        v.controllers(spark, folder), _stub_scorer, "scenario_id", ["scenario_id", "behavior_tree"],
        repeats=10, skip_empty="behavior_tree",
    )
    return runs.groupBy("scenario_id").agg(
        F.count("score").alias("n_scores"), stable(F.avg("score")).alias("avg_score")
    )


@query("collect_scores", f"""
WITH {v.CONTROLLERS}, k AS (
  SELECT scenario_id, (scenario_id % 97 + i) / 8.0 AS s, i FROM controllers, range(5) t(i)
  WHERE behavior_tree <> '' AND (scenario_id + i) % 4 <> 0)
SELECT scenario_id, CAST(row_number() OVER (PARTITION BY scenario_id ORDER BY i) - 1 AS INTEGER) AS pos, CAST(s AS DOUBLE) AS score,
  {r('avg(s) OVER (PARTITION BY scenario_id)')} AS avg_score FROM k""")
def collect_scores(spark, folder):
    runs = hooks.map_score(
        v.controllers(spark, folder), _stub_scorer, "scenario_id", ["scenario_id", "behavior_tree"],
        repeats=5, skip_empty="behavior_tree",
    )
    scored = hooks.collect_scores(runs, "scenario_id")
    return scored.select(
        "scenario_id", stable("avg_score").alias("avg_score"), F.posexplode("scores").alias("pos", "score")
    )


# --- tracks ------------------------------------------------------------------------------------------


@query("motion_mask", f"""
WITH {v.FRAMES}, d AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY clip, cell ORDER BY frame)) AS c FROM frames)
SELECT clip, cell, frame, {r('c')} AS change, coalesce(c > 30, false) AS moved FROM d""")
def motion_mask(spark, folder):
    out = tracks.motion_mask(v.frames(spark, folder), ["clip", "cell"], "frame", "value")
    return out.select("clip", "cell", "frame", stable("change").alias("change"), "moved")


@query("motion_trace", f"""
WITH {v.FRAMES}, n AS (SELECT clip, max(frame) + 1 AS n FROM frames GROUP BY 1),
d AS (SELECT f.*, n, abs(value - lag(value) OVER (PARTITION BY f.clip, cell ORDER BY frame)) AS c FROM frames f JOIN n ON n.clip = f.clip)
SELECT clip, cell, {r('greatest(0, least(255, sum(CASE WHEN c > 30 THEN 255 * exp(-5.0 * (n - frame) / n) ELSE 0 END)))')} AS trace
FROM d GROUP BY 1, 2""")
def motion_trace(spark, folder):
    out = tracks.motion_trace(v.frames(spark, folder), "clip", "cell", "frame", "value")
    return with_stable(out, ["trace"])


@query("every_nth", """
WITH k AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
SELECT event_id, user_id FROM k WHERE i % 10 = 0""")
def every_nth(spark, folder):
    rows = v.table(spark, folder, "events").select("event_id", "user_id")
    return tracks.every_nth(rows, ["user_id"], ["event_id"])


@query("track_link", f"""
WITH RECURSIVE {v.DETECTIONS}, walk AS (
  SELECT clip, frame, det, x, y FROM detections WHERE frame = 0 AND det = (
    SELECT min(det) FROM detections d WHERE d.clip = detections.clip AND d.frame = 0)
  UNION ALL
  SELECT clip, frame, det, x, y FROM (
    SELECT d.clip, d.frame, d.det, d.x, d.y, row_number() OVER (PARTITION BY d.clip
      ORDER BY sqrt((d.x - w.x) * (d.x - w.x) + (d.y - w.y) * (d.y - w.y)), d.det) AS k
    FROM walk w JOIN detections d ON d.clip = w.clip AND d.frame = w.frame + 1
      AND sqrt((d.x - w.x) * (d.x - w.x) + (d.y - w.y) * (d.y - w.y)) < 150) WHERE k = 1)
SELECT clip, frame, det, x, y FROM walk WHERE frame > 0""")
def track_link(spark, folder):
    found = v.detections(spark, folder)
    first = found.filter("frame = 0").groupBy("clip").agg(F.min("det").alias("_first"))
    # number the first detection of each clip 0, as the track starts there
    numbered = found.join(first, "clip", "left").withColumn(
        "start", (F.col("frame") == 0) & (F.col("det") == F.col("_first"))
    )
    return tracks.link_tracks(numbered.drop("_first"), start="start", max_dist=150.0)
