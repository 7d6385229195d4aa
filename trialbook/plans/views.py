"""Views that give the sample tables the shape of experiment tables.

Each view exists twice: as a DataFrame for the queries and as SQL for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialbook.functions.scores import array_mean
from trialbook.plans.registry import stable, stable_sql


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- scored scenarios: orders with the scores of their lines -----------------------

LLM_PRICE = "l_extendedprice * (1 - l_discount) * (1 + l_tax)"


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Scenarios with both average scores; NULL for an order without lines."""
    lines = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("scenario_id"))
        .agg(
            stable(F.avg("l_extendedprice")).alias("avg_score"),
            stable(F.avg(F.expr(LLM_PRICE))).alias("llm_avg_score"),
        )
    )
    return _scenarios(spark, folder).join(lines, "scenario_id", "left")


# Five numbers of an order as its repeated scores; of these 0 to 5 are kept, or none at all.
_SCORES = [
    "o_totalprice",
    "o_totalprice * 0.5 + o_custkey",
    "CAST(o_custkey AS DOUBLE)",
    "CAST(o_orderkey % 1000 AS DOUBLE)",
    "o_totalprice * 0.25 - 1000",
]
_LLM_SCORES = [f"({s}) * 0.9 + o_custkey % 10" for s in _SCORES]


def scored_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """Scenarios with score arrays held in the row; missing for every seventh, empty for others."""

    def array(parts: list[str]) -> Column:
        whole = F.array(*[stable(F.expr(x)) for x in parts])
        kept = F.slice(whole, 1, (F.col("o_orderkey") % 7 % 6).cast("int"))
        return F.when(F.col("o_orderkey") % 7 != 0, kept)

    orders = table(spark, folder, "orders").select(
        *scenario_columns(), array(_SCORES).alias("scores"), array(_LLM_SCORES).alias("llm_scores")
    )
    return orders.select(
        "*",
        stable(array_mean(F.col("scores"))).alias("avg_score"),
        stable(array_mean(F.col("llm_scores"))).alias("llm_avg_score"),
    )


def scenario_columns() -> list[Column]:
    return [
        F.col("o_orderkey").alias("scenario_id"),
        F.col("o_orderpriority").alias("type"),
        F.col("o_orderstatus").alias("lightstype"),
        F.concat(F.lit("evaluated_"), F.year("o_orderdate").cast("string")).alias("dataset"),
    ]


def _scenarios(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(*scenario_columns())


_SCENARIO_COLUMNS = """o_orderkey AS scenario_id, o_orderpriority AS type,
    o_orderstatus AS lightstype, 'evaluated_' || CAST(year(o_orderdate) AS VARCHAR) AS dataset"""

SCORED = f"""scored AS (
  SELECT {_SCENARIO_COLUMNS}, {stable_sql('avg(l_extendedprice)')} AS avg_score,
    {stable_sql(f'avg({LLM_PRICE})')} AS llm_avg_score
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
  GROUP BY o_orderkey, o_orderpriority, o_orderstatus, o_orderdate)"""


def _list(parts: list[str]) -> str:
    values = ", ".join(stable_sql(x) for x in parts)
    return f"CASE WHEN o_orderkey % 7 <> 0 THEN list_slice([{values}], 1, o_orderkey % 7 % 6) END"


ARRAYS = f"""arrays AS (
  SELECT {_SCENARIO_COLUMNS}, {_list(_SCORES)} AS s, {_list(_LLM_SCORES)} AS ls FROM orders)"""


def complete(spark: SparkSession, folder: str) -> DataFrame:
    """Scored scenarios without gaps."""
    return scored(spark, folder).na.drop("any")


COMPLETE = SCORED + """, complete AS (
  SELECT * FROM scored WHERE avg_score IS NOT NULL AND llm_avg_score IS NOT NULL)"""


# --- controllers: flag/value text from part ----------------------------------------


def _controller_text(div: str, text: str, most: int = 4) -> str:
    """SQL text of a controller with p_size % most + 1 branches; some break the grammar on purpose."""

    def word(expr: str) -> str:
        return f"CAST({expr} AS {text})"

    def branch(i: int) -> str:
        cond = f"((p_partkey + {i}) % 6)"
        act = f"((p_partkey {div} 7 + {i}) % 6)"
        fraction = f"'0.' || lpad({word(f'(p_partkey * {i + 3}) % 1000')}, 3, '0')"
        decimal = f"{word(f'(p_partkey + {i}) % 6')} || '.25'"
        return f"""CASE WHEN p_size % {most} >= {i} THEN
          ' --n{i} 0 --nchild{i} 2 --n{i}0 6 --c{i}0 ' || {word(cond)}
          || ' --p{i}0 ' || CASE WHEN {cond} IN (3, 4) THEN {word('p_partkey % 10 + 1')} ELSE {fraction} END
          || CASE WHEN {cond} IN (3, 4) THEN ' --w{i}0 ' || {word('p_partkey % 25')} ELSE '' END
          || ' --n{i}1 5 --a{i}1 ' || {word(act)}
          || CASE WHEN {act} = 0 THEN ' --rwm{i}1 ' || {word(f'(p_partkey * {i + 1}) % 110')}
                  WHEN {act} = 4 THEN ' --att{i}1 ' || {decimal}
                  WHEN {act} = 5 THEN ' --rep{i}1 ' || {decimal} ELSE '' END
          || ' --p{i}1 0' ELSE '' END"""

    branches = " || ".join(branch(i) for i in range(most))
    return f"""CASE WHEN p_partkey % 23 = 0 THEN '' ELSE
      '--nroot 3 --nchildroot ' || {word(f'p_size % {most} + 1')} || {branches}
      || CASE WHEN p_partkey % 29 = 0 THEN ' --zz 1' ELSE '' END END"""


def controllers(spark: SparkSession, folder: str, most: int = 4) -> DataFrame:
    return controllers_of(table(spark, folder, "part"), most)


def controllers_of(parts: DataFrame, most: int = 4) -> DataFrame:
    return parts.select(
        F.col("p_partkey").alias("scenario_id"),
        F.expr(_controller_text("div", "STRING", most)).alias("behavior_tree"),
    )


CONTROLLERS = f"""controllers AS (
  SELECT p_partkey AS scenario_id, {_controller_text('//', 'VARCHAR')} AS behavior_tree FROM part)"""


# --- configurations: XML text from supplier ------------------------------------------

_CONFIG_NUMBERS = {
    "cx": "(s_suppkey % 5 - 2)",
    "cy": "(s_suppkey % 7 - 3)",
    "r": "(s_suppkey % 9 + 1)",
    "kind": "(s_suppkey % 4)",
    "turn": "(s_suppkey % 90)",
}


def configurations(spark: SparkSession, folder: str) -> DataFrame:
    """Scenario documents; every 17th is cut off in the middle."""
    n = {k: f"CAST({v} AS STRING)" for k, v in _CONFIG_NUMBERS.items()}
    text = f"""
      '<?xml version="1.00" ?><config><env-elems><light id="light_' || CAST(s_suppkey AS STRING)
      || '" position="' || {n['cx']} || ',' || {n['cy']} || '.5,0.00" orientation="270,0,0" color="yellow" intensity="'
      || {n['r']} || '.25" medium="leds"/>'
      || '<light id="extra" position="bad" orientation="0,0,0" color="red" intensity="5.00" medium="leds"/>'
      || '<arena-attrib size="' || {n['r']} || ',' || {n['r']} || '.5,1.95"/></env-elems><objective-elems>'
      || '<spawnCircle position="0,0,0" radius="0.55"/><circle position="' || {n['cx']} || ',' || {n['cy']}
      || '" radius="0.' || {n['r']} || '" color="black"/><circle position="-1.25,0.75" radius="0.36" color="white"/>'
      || '<rectangle center="' || {n['cx']} || ',' || {n['cy']} || '.25" angle="' || CAST(s_suppkey % 90 AS STRING) || '" width="0.' || {n['r']} || '" height="0.15" color="white"/>'
      || '<spawnRectangle center="0.3,-0.2" angle="45" width="0.' || {n['r']} || '" height="0.4"/>'
      || '<epuck position="' || {n['cx']} || ',0.5"/><epuck position="1,2"/>'
      || CASE WHEN s_suppkey % 17 = 0 THEN '<objective type=' ELSE
           CASE s_suppkey % 4
             WHEN 0 THEN '<objective type="aggregation"><objective-params target-color="black" radius="0.' || {n['r']} || '"/></objective>'
             WHEN 1 THEN '<objective type="connection"><objective-params conn_start="white" conn_end="black" connection_range="0.' || {n['r']} || '"/></objective>'
             WHEN 2 THEN '<objective type="distribution"><objective-params area="' || {n['r']} || ',2.5" connection_range="0.2"/></objective>'
             ELSE '<objective type="foraging"><objective-params source="black" sink="white"/></objective>' END
           || '</objective-elems></config>' END"""
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("scenario_id"), F.expr(text).alias("configuration")
    )


CONFIG_COLUMNS = ", ".join(f"{v} AS {k}" for k, v in _CONFIG_NUMBERS.items())
CONFIGURATIONS = f"""configs AS (
  SELECT s_suppkey AS scenario_id, {CONFIG_COLUMNS} FROM supplier WHERE s_suppkey % 17 <> 0)"""


# --- positions: events as robot positions, nation and region as arenas ---------------

RUNS = ["click", "error", "purchase", "signup", "view"]
_X = "((event_id * 37) % 401 - 200) / 100.0"
_Y = "((event_id * 53 + user_id * 7) % 301 - 150) / 100.0"


def robot_positions(spark: SparkSession, folder: str) -> DataFrame:
    return robot_positions_of(table(spark, folder, "events"))


def robot_positions_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_type").alias("run_id"),
        F.col("user_id").cast("string").alias("robot_id"),
        F.col("event_id").alias("tick"),
        F.expr(f"CAST({_X} AS DOUBLE)").alias("x"),
        F.expr(f"CAST({_Y} AS DOUBLE)").alias("y"),
    )


POSITIONS = f"""positions AS (
  SELECT event_type AS run_id, CAST(user_id AS VARCHAR) AS robot_id, event_id AS tick,
    CAST({_X} AS DOUBLE) AS x, CAST({_Y} AS DOUBLE) AS y FROM events)"""


def _run_of(key: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(RUNS))
    return f"CASE {key} {cases} END"


_CIRCLE_COLOR = "CASE n_nationkey % 3 WHEN 0 THEN 'black' WHEN 1 THEN 'white' ELSE 'red' END"
_CIRCLES = f"""SELECT {_run_of('n_regionkey')} AS run_id, n_nationkey AS circle_no,
    CAST(((n_nationkey * 29) % 31 - 15) / 10.0 AS DOUBLE) AS x,
    CAST(((n_nationkey * 17) % 23 - 11) / 10.0 AS DOUBLE) AS y,
    CAST((n_nationkey % 5 + 3) / 10.0 AS DOUBLE) AS radius, {_CIRCLE_COLOR} AS color FROM nation"""
_RECTS = f"""SELECT {_run_of('n_regionkey')} AS run_id, n_nationkey AS rect_no,
    CAST(((n_nationkey * 13) % 31 - 15) / 10.0 AS DOUBLE) AS x,
    CAST(((n_nationkey * 19) % 23 - 11) / 10.0 AS DOUBLE) AS y,
    CAST((n_nationkey % 4 + 2) / 10.0 AS DOUBLE) AS half_w,
    CAST((n_nationkey % 3 + 1) / 10.0 AS DOUBLE) AS half_h,
    CAST((n_nationkey * 23) % 90 AS DOUBLE) AS angle_deg,
    CASE n_nationkey % 2 WHEN 0 THEN 'white' ELSE 'black' END AS color FROM nation"""
_OBJECTIVES = f"""SELECT {_run_of('r_regionkey')} AS run_id,
    CASE r_regionkey WHEN 0 THEN 'aggregation' WHEN 1 THEN 'connection' WHEN 2 THEN 'distribution'
      WHEN 3 THEN 'foraging' ELSE 'aggregation' END AS kind,
    'black' AS target_color, 'white' AS conn_start, 'black' AS conn_end,
    CAST(0.25 AS DOUBLE) AS connection_range, CAST(2.0 AS DOUBLE) AS area_w,
    CAST(1.28 AS DOUBLE) AS area_h, 'black' AS source, 'white' AS sink FROM region"""

CIRCLES = f"circles AS ({_CIRCLES})"
RECTANGLES = f"rects AS ({_RECTS})"
OBJECTIVES = f"objectives AS ({_OBJECTIVES})"


def _from(spark: SparkSession, folder: str, name: str, sql: str) -> DataFrame:
    text = sql.replace(f"FROM {name}", "FROM {source}")
    return spark.sql(text, source=table(spark, folder, name))


def floor_circles(spark: SparkSession, folder: str) -> DataFrame:
    return _from(spark, folder, "nation", _CIRCLES)


def floor_rectangles(spark: SparkSession, folder: str) -> DataFrame:
    return _from(spark, folder, "nation", _RECTS)


def run_objectives(spark: SparkSession, folder: str) -> DataFrame:
    return _from(spark, folder, "region", _OBJECTIVES)


def arena(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Positions, circles and objectives together."""
    return (
        robot_positions(spark, folder),
        floor_circles(spark, folder),
        run_objectives(spark, folder),
    )


ARENA = f"{POSITIONS}, {CIRCLES}, {OBJECTIVES}"


# --- dialog: a user turn and the assistant turn right after it -------------------------


def dialog(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    users = turns.filter("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("llmin"), (F.col("turn") + 1).alias("_next")
    )
    answers = turns.filter("role = 'assistant'").select(
        F.col("conv_id"), F.col("turn").alias("_next"), F.col("text").alias("llmout")
    )
    return users.join(answers, ["conv_id", "_next"]).drop("_next")


DIALOG = """dialog AS (
  SELECT u.conv_id, u.turn, u.text AS llmin, a.text AS llmout
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


# --- judged: documents with their labels, two answers per row ---------------------------


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as prompts with two answers; the score of the second is the label, often missing."""
    documents = table(spark, folder, "documents")
    labels = table(spark, folder, "labels")
    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("scenario_id"),
        F.col("lang").alias("type"),
        F.col("text").alias("llmin"),
        F.concat(F.lit("first "), F.col("source")).alias("llmout_A"),
        F.concat(F.lit("second "), F.col("source")).alias("llmout_B"),
        F.expr("CAST(n_chars % 7 AS DOUBLE) / 4").alias("scores_bt1"),
        F.expr("CAST(quality + n_chars % 3 AS DOUBLE) / 2").alias("scores_bt2"),
    )


JUDGED = """judged AS (
  SELECT d.doc_id AS scenario_id, lang AS type, text AS llmin, 'first ' || source AS llmout_A,
    'second ' || source AS llmout_B, CAST(n_chars % 7 AS DOUBLE) / 4 AS scores_bt1,
    CAST(quality + n_chars % 3 AS DOUBLE) / 2 AS scores_bt2
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


# --- epochs: judged pairs spread over epochs ---------------------------------------------


def epochs(spark: SparkSession, folder: str) -> DataFrame:
    return judged(spark, folder).withColumn(
        "dataset_position", (F.col("scenario_id") % 5).cast("int")
    )


EPOCHS = JUDGED + """, epochs AS (
  SELECT *, CAST(scenario_id % 5 AS INTEGER) AS dataset_position FROM judged)"""


# --- run output: events as log lines --------------------------------------------------------

_LINE = """CASE event_type
    WHEN 'click' THEN 'Score ' || CAST(value AS {text})
    WHEN 'view' THEN 'Score -' || CAST(value AS {text})
    WHEN 'signup' THEN 'Current Score ' || CAST(value AS {text}) || 'e-05'
    WHEN 'purchase' THEN 'Score ' || CAST(value AS {text}) || 'e+02'
    ELSE 'segmentation fault' END"""


def run_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("line_no"),
        F.expr(_LINE.format(text="STRING")).alias("text"),
    )


RUN_LINES = f"""run_lines AS (
  SELECT user_id AS run_id, event_id AS line_no, {_LINE.format(text='VARCHAR')} AS text FROM events)"""


# --- detections and frames -------------------------------------------------------------------


def detections(spark: SparkSession, folder: str) -> DataFrame:
    """About four detections per clip and frame, over a plane of 400 by 300."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("clip"),
        F.expr("event_id div 20").alias("frame"),
        (F.col("event_id") % 20).alias("det"),
        ((F.col("event_id") * 37) % 401).cast("double").alias("x"),
        ((F.col("event_id") * 53 + F.col("user_id") * 7) % 301).cast("double").alias("y"),
    )


DETECTIONS = """detections AS (
  SELECT event_type AS clip, event_id // 20 AS frame, event_id % 20 AS det,
    CAST((event_id * 37) % 401 AS DOUBLE) AS x,
    CAST((event_id * 53 + user_id * 7) % 301 AS DOUBLE) AS y FROM events)"""


def frames(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_type").alias("clip"),
        F.col("user_id").alias("cell"),
        F.col("event_id").alias("frame"),
        F.col("value"),
    )


FRAMES = """frames AS (
  SELECT event_type AS clip, user_id AS cell, event_id AS frame, value FROM events)"""
