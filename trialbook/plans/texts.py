"""Queries over sources, text, controllers and XML."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialbook.functions import controllers as ctl
from trialbook.functions import scores as fs
from trialbook.functions import texts as ft
from trialbook.operators import combine, preferences, scaling, scenario, splits, xmlconfig
from trialbook.plans import views as v
from trialbook.plans.registry import query
from trialbook.sources import datasets, logs

# --- sources -------------------------------------------------------------------------


@query("read_dataset", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def read_dataset(spark, folder):
    schema = "o_orderkey bigint, o_orderstatus string, o_totalprice double"
    return datasets.read_dataset(spark, f"{folder}/orders.parquet", schema)


@query("read_tagged", """
SELECT 'orders.parquet' AS dataset, o_orderpriority AS type, count(*) AS n FROM orders GROUP BY 2""")
def read_tagged(spark, folder):
    rows = datasets.read_tagged(spark, folder, "o_orderpriority string", suffix="order*.parquet")
    return rows.groupBy(F.col("Dataset").alias("dataset"), F.col("o_orderpriority").alias("type")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("read_tagged_several", """
SELECT 'documents.parquet' AS dataset, count(text) AS n, count(lang) AS n_lang, count(turn) AS n_turn, sum(length(text))::BIGINT AS chars
FROM (SELECT text, lang, NULL AS turn FROM documents)
UNION ALL SELECT 'benchmark.parquet', count(text), 0, 0, sum(length(text))::BIGINT FROM benchmark
UNION ALL SELECT 'conversations.parquet', count(text), 0, count(turn), sum(length(text))::BIGINT FROM conversations""")
def read_tagged_several(spark, folder):
    """Three files that share one column; what a file lacks is NULL."""
    shared = "text string, lang string, turn long"
    rows = datasets.read_tagged(spark, folder, shared, suffix="{documents,benchmark,conversations}.parquet")
    counts = [F.count(c).alias(n) for c, n in (("text", "n"), ("lang", "n_lang"), ("turn", "n_turn"))]
    return rows.groupBy(F.col("Dataset").alias("dataset")).agg(*counts, F.sum(F.length("text")).alias("chars"))


@query("result_log", f"""
WITH {v.CONTROLLERS} SELECT scenario_id, behavior_tree FROM controllers WHERE scenario_id % 31 <> 0""")
def result_log(spark, folder):
    tag = F.concat(F.lit("experiment_"), F.col("scenario_id").cast("string"))
    line = F.concat(tag, F.lit("; "), F.col("behavior_tree"))
    lines = v.controllers(spark, folder).select(
        F.when(F.col("scenario_id") % 31 == 0, F.lit("  ")).otherwise(line).alias("value")
    )
    return logs.parse_result_log(lines)


@query("score_first", f"""
WITH {v.RUN_LINES}, f AS (
  SELECT run_id, arg_min(text, line_no) AS t FROM run_lines WHERE starts_with(text, 'Score') GROUP BY 1)
SELECT run_id, CAST(nullif(regexp_extract(t, '-?[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE) AS score FROM f""")
def score_first(spark, folder):
    return logs.first_score(v.run_lines(spark, folder), "run_id", "line_no", "text")


@query("score_last", f"""
WITH {v.RUN_LINES}, f AS (
  SELECT run_id, arg_max(text, line_no) AS t FROM run_lines WHERE contains(text, 'Score') GROUP BY 1)
SELECT run_id, -CAST(regexp_extract(t, 'Score ([-+0-9.e]+)', 1) AS DOUBLE) AS score FROM f""")
def score_last(spark, folder):
    return logs.last_score(v.run_lines(spark, folder), "run_id", "line_no", "text")


@query("row_lookup", f"""
WITH {v.SCORED} SELECT scenario_id, avg_score, type FROM scored WHERE scenario_id = 77""")
def row_lookup(spark, folder):
    wanted = ["avg_score", "type", "llm_behavior_tree"]
    return datasets.row_lookup(v.scored(spark, folder), "scenario_id", 77, wanted)


def _training_log(spark, folder):
    kind = F.col("event_type")
    return v.table(spark, folder, "events").select(
        (F.col("event_id") / 100.0).cast("double").alias("epoch"),
        F.when(kind.isin("click", "view"), F.col("value")).alias("loss"),
        F.when(kind == "purchase", F.col("value")).alias("eval_loss"),
        F.when(kind == "signup", F.col("value")).alias("train_runtime"),
        F.when(kind == "signup", F.col("value") * 2).alias("train_samples_per_second"),
        F.when(kind == "signup", F.col("value") * 4).alias("train_steps_per_second"),
        F.when(kind == "signup", F.col("value") * 8).alias("total_flos"),
    )


@query("log_series", """
SELECT 'train' AS series, CAST(event_id / 100.0 AS DOUBLE) AS epoch, value FROM events WHERE event_type IN ('click', 'view')
UNION ALL SELECT 'eval', CAST(event_id / 100.0 AS DOUBLE), value FROM events WHERE event_type = 'purchase'""")
def log_series(spark, folder):
    return logs.log_series(_training_log(spark, folder))


@query("log_metrics", """
SELECT m AS metric, value * f AS value FROM events, (VALUES ('train_runtime', 1), ('train_samples_per_second', 2),
  ('train_steps_per_second', 4), ('total_flos', 8)) t(m, f) WHERE event_type = 'signup'""")
def log_metrics(spark, folder):
    return logs.final_metrics(_training_log(spark, folder))


@query("concat", f"""
WITH {v.SCORED}, {v.CONTROLLERS}, u AS (
  SELECT 'a' AS source, scenario_id, avg_score, NULL AS behavior_tree FROM scored
  UNION ALL SELECT 'b', scenario_id, NULL, behavior_tree FROM controllers)
SELECT row_number() OVER (ORDER BY source, scenario_id) - 1 AS original_index, * FROM u""")
def concat(spark, folder):
    parts = {
        "a": v.scored(spark, folder).select("scenario_id", "avg_score"),
        "b": v.controllers(spark, folder),
    }
    return splits.row_ids(combine.tagged_union(parts, "source"), ["source", "scenario_id"])


# --- scalar columns -------------------------------------------------------------------


def _parameters(spark, folder):
    kind = F.element_at(
        F.array(*[F.lit(x) for x in ("Aggregation", "Foraging", "Distribution", "Connection")]),
        (F.col("p_partkey") % 4 + 1).cast("int"),
    )
    area = F.when(F.col("p_partkey") % 3 == 0, "BLACK").when(F.col("p_partkey") % 3 == 1, "WHITE")
    return v.table(spark, folder, "part").select(
        F.col("p_partkey").alias("scenario_id"),
        F.struct(
            F.struct(
                kind.alias("kind"),
                (F.col("p_size") % 2 + 1).cast("int").alias("agg_target"),
                F.struct(area.alias("color")).alias("ground_area_1"),
                F.struct(F.lit("WHITE").alias("color")).alias("ground_area_2"),
            ).alias("objective"),
            F.struct(F.col("p_type").alias("kind")).alias("lights"),
            F.struct(F.col("p_brand").alias("kind")).alias("arena"),
            F.struct(F.col("p_name").alias("kind")).alias("robots"),
        ).alias("parameters"),
    )


@query("category_labels", """
SELECT p_partkey AS scenario_id, CASE p_partkey % 4 WHEN 0 THEN 'Aggregation' WHEN 1 THEN 'Foraging'
    WHEN 2 THEN 'Distribution' ELSE 'Connection' END AS type,
  p_type AS lightstype, p_brand AS arenatype, p_name AS robotstype FROM part""")
def category_labels(spark, folder):
    return scenario.category_labels(_parameters(spark, folder)).drop("parameters")


@query("target_color", """
SELECT p_partkey AS scenario_id,
  CASE WHEN p_size % 2 + 1 = 1 AND p_partkey % 3 = 0 THEN 'black' ELSE 'white' END AS target_color FROM part""")
def target_color(spark, folder):
    color = scenario.target_color_of(F.col("parameters.objective"))
    return _parameters(spark, folder).select("scenario_id", color.alias("target_color"))


@query("row_id", """
SELECT o_orderkey AS scenario_id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS original_index FROM orders""")
def row_id(spark, folder):
    rows = v.table(spark, folder, "orders").select(F.col("o_orderkey").alias("scenario_id"), "o_orderdate")
    return splits.row_ids(rows, ["o_orderdate", "scenario_id"]).drop("o_orderdate")


@query("formal_view", f"""
WITH {v.DIALOG} SELECT conv_id, turn, llmout AS description FROM dialog""")
def formal_view(spark, folder):
    rows = v.dialog(spark, folder).withColumnsRenamed({"llmin": "description", "llmout": "configuration"})
    return scenario.formal_view(rows).drop("configuration")


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _wrap(user: str, answer: str, instruction: str) -> str:
    return f"'<s>[INST] ' || {user} || {_sql_text(instruction)} || ' [/INST] ' || {answer} || '</s>'"


@query("sft_text", f"""
WITH {v.DIALOG} SELECT conv_id, turn, {_wrap('llmin', 'llmout', ft.SHORT_INSTRUCTION)} AS text FROM dialog""")
def sft_text(spark, folder):
    return preferences.training_text(v.dialog(spark, folder), "llmin", "llmout").drop("llmin", "llmout")


@query("sft_text_long", f"""
WITH {v.DIALOG} SELECT conv_id, turn, {_wrap('llmin', 'llmout', ft.LONG_INSTRUCTION)} AS text FROM dialog""")
def sft_text_long(spark, folder):
    rows = preferences.training_text(v.dialog(spark, folder), "llmin", "llmout", ft.long_prompt)
    return rows.drop("llmin", "llmout")


@query("sft_text_raw", f"""
WITH {v.DIALOG} SELECT conv_id, turn, {_wrap('llmin', 'llmout', '')} AS text FROM dialog""")
def sft_text_raw(spark, folder):
    rows = preferences.training_text(v.dialog(spark, folder), "llmin", "llmout", ft.raw_prompt)
    return rows.drop("llmin", "llmout")


@query("open_prompt", f"""
WITH {v.DIALOG} SELECT conv_id, turn,
  '[INST] ' || llmin || {_sql_text(ft.SHORT_INSTRUCTION)} || ' [/INST]' AS prompt FROM dialog""")
def open_prompt(spark, folder):
    return v.dialog(spark, folder).select("conv_id", "turn", ft.open_prompt(F.col("llmin")).alias("prompt"))


@query("extract_response", f"""
WITH {v.DIALOG} SELECT conv_id, turn, CASE WHEN conv_id % 3 <> 0 THEN ' ' || llmout END AS answer,
  CASE WHEN conv_id % 3 <> 0 THEN ' ' || llmout ELSE llmin END AS answer_or_all FROM dialog""")
def extract_response(spark, folder):
    wrapped = ft.raw_prompt(F.col("llmin"), F.concat("llmout", F.lit("</s> rest")))
    output = F.when(F.col("conv_id") % 3 != 0, wrapped).otherwise(F.col("llmin"))
    return v.dialog(spark, folder).select(
        "conv_id",
        "turn",
        ft.extract_response(output).alias("answer"),
        ft.extract_response(output, fallback=True).alias("answer_or_all"),
    )


@query("insert_before", """
SELECT page_id, CASE WHEN contains(html, '<article>') AND contains(substr(html, instr(html, '<article>')), '</article>')
  THEN substr(html, 1, instr(html, '<article>') + instr(substr(html, instr(html, '<article>')), '</article>') - 2)
    || '<i>new</i>' || substr(html, instr(html, '<article>') + instr(substr(html, instr(html, '<article>')), '</article>') - 1)
  ELSE html END AS html FROM pages""")
def insert_before(spark, folder):
    changed = ft.insert_before(F.col("html"), "<article>", "</article>", "<i>new</i>")
    return v.table(spark, folder, "pages").select("page_id", changed.alias("html"))


@query("uncomment", """
WITH p AS (SELECT page_id, replace(replace(html, chr(10), ' '), 'qt-opengl', '') AS line FROM pages)
SELECT page_id, '<!-- a -->' || chr(10) || ' <qt-opengl>' || chr(10)
  || regexp_replace(regexp_replace(line, '<!--', ''), '-->', '') || chr(10) || '</qt-opengl>' || chr(10) || '<!-- b -->' AS text FROM p""")
def uncomment(spark, folder):
    line = F.replace(F.replace("html", F.lit("\n"), F.lit(" ")), F.lit("qt-opengl"), F.lit(""))
    text = F.concat(
        F.lit("<!-- a -->\n<!-- <qt-opengl>\n"), line, F.lit("\n</qt-opengl>-->\n<!-- b -->")
    )
    return v.table(spark, folder, "pages").select("page_id", ft.uncomment_block(text).alias("text"))


@query("truncate_floats", """
SELECT event_id, 'at ' || CAST(floor(value) AS BIGINT) || '.' || CAST(event_id % 10 AS VARCHAR) || '5 and 0.12 of 7, x 1.5' AS text FROM events""")
def truncate_floats(spark, folder):
    text = F.concat(
        F.lit("at "), F.floor("value").cast("string"), F.lit("."),
        (F.col("event_id") % 10).cast("string"), F.lit("56789 and 0.12345 of 7, x 1.5"),
    )
    return v.table(spark, folder, "events").select("event_id", ft.truncate_floats(text).alias("text"))


@query("vec_parse", """
SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS x,
  CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_nationkey AS DOUBLE) END AS y,
  CASE WHEN s_suppkey % 5 <> 0 THEN CAST(-0.5 AS DOUBLE) END AS z FROM supplier""")
def vec_parse(spark, folder):
    head = F.concat(F.col("s_acctbal").cast("decimal(20,2)").cast("string"), F.lit(", "), F.col("s_nationkey").cast("string"))
    tail = F.when(F.col("s_suppkey") % 10 == 0, "").when(F.col("s_suppkey") % 5 == 0, ",a").otherwise(",-0.50")
    vec = ft.vector(F.concat(head, tail), 3)
    return v.table(spark, folder, "supplier").select(
        "s_suppkey", *[F.get(vec, F.lit(i)).alias(n) for i, n in enumerate("xyz")]
    )


@query("render_template", """
SELECT s_suppkey, '<run id="' || s_suppkey || '"><name>' || s_name || '</name><n>' || s_nationkey || '</n></run>' AS text FROM supplier""")
def render_template(spark, folder):
    skeleton = '<run id="{id}"><name>{name}</name><n>{nation}</n></run>'
    marks = {"{id}": "s_suppkey", "{name}": "s_name", "{nation}": "s_nationkey"}
    values = {m: F.col(c).cast("string") for m, c in marks.items()}
    return v.table(spark, folder, "supplier").select(
        "s_suppkey", ft.fill_template(skeleton, values).alias("text")
    )


@query("batch_plan", """
WITH n AS (SELECT o_orderkey AS scenario_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS i,
  CAST(ceil(count(*) OVER () / 50.0) AS BIGINT) AS per_batch FROM orders)
SELECT scenario_id, per_batch, i // per_batch AS batch, per_batch * 9000 + 300 AS budget_seconds,
  CAST((per_batch * 9000 + 300) // 3600 AS VARCHAR) || ':' || lpad(CAST((per_batch * 9000 + 300) % 3600 // 60 AS VARCHAR), 2, '0')
  || ':' || lpad(CAST((per_batch * 9000 + 300) % 60 AS VARCHAR), 2, '0') AS budget FROM n""")
def batch_plan(spark, folder):
    orders = v.table(spark, folder, "orders").select(F.col("o_orderkey").alias("scenario_id"))
    total = orders.agg(F.count(F.lit(1)).alias("n")).scalar()
    numbered = splits.row_ids(orders, ["scenario_id"])
    return scenario.batch_plan(numbered, "original_index", total).drop("original_index")


@query("clip", """
SELECT event_id, CASE WHEN event_type = 'signup' THEN NULL ELSE greatest(10.0::DOUBLE, least(100.0::DOUBLE, value)) END AS clipped,
  abs(value - 100) AS distance FROM events""")
def clip(spark, folder):
    value = F.when(F.col("event_type") != "signup", F.col("value"))
    return v.table(spark, folder, "events").select(
        "event_id",
        fs.clip(value, 10.0, 100.0).alias("clipped"),
        F.abs(F.col("value") - 100).alias("distance"),
    )


# --- filters ------------------------------------------------------------------------------


@query("filter_type", f"WITH {v.SCORED} SELECT * FROM scored WHERE type = '2-HIGH'")
def filter_type(spark, folder):
    return v.scored(spark, folder).filter(F.col("type") == "2-HIGH")


@query("dropna_any", f"WITH {v.COMPLETE} SELECT scenario_id, avg_score FROM complete")
def dropna_any(spark, folder):
    return scaling.complete_rows(v.scored(spark, folder)).select("scenario_id", "avg_score")


@query("dropna_subset", f"WITH {v.JUDGED} SELECT scenario_id, scores_bt2 FROM judged WHERE scores_bt2 IS NOT NULL")
def dropna_subset(spark, folder):
    rows = v.judged(spark, folder).select("scenario_id", "scores_bt2")
    return scaling.complete_rows(rows, ["scores_bt2"])


@query("drop_inf", "SELECT event_id FROM events WHERE event_id % 7 <> 0")  # NaN and NULL stay
def drop_inf(spark, folder):
    endless = F.when(F.col("event_id") % 7 == 0, F.lit(float("-inf"))).otherwise(
        F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 != 0, F.col("value"))
    )
    rows = v.table(spark, folder, "events").select("event_id", endless.alias("x"))
    return scaling.drop_infinite(rows).select("event_id")


@query("nonempty_bt", f"WITH {v.CONTROLLERS} SELECT scenario_id FROM controllers WHERE behavior_tree <> ''")
def nonempty_bt(spark, folder):
    return v.controllers(spark, folder).filter(F.length("behavior_tree") > 0).select("scenario_id")


@query("first_over", f"""
WITH {v.SCORED} SELECT scenario_id, avg_score FROM scored WHERE avg_score > 40000 ORDER BY scenario_id LIMIT 1""")
def first_over(spark, folder):
    over = v.scored(spark, folder).filter(F.col("avg_score") > 40000)
    return splits.first_k(over.select("scenario_id", "avg_score"), [F.col("scenario_id")], 1)


@query("exists", f"""
WITH {v.SCORED} SELECT bool_or(avg_score > 60000) AS found, bool_or(avg_score < 0) AS negative FROM scored""")
def exists(spark, folder):
    score = F.col("avg_score")
    return v.scored(spark, folder).agg(
        F.bool_or(score > 60000).alias("found"), F.bool_or(score < 0).alias("negative")
    )


# --- controllers -----------------------------------------------------------------------------


@query("bt_tokens", f"""
WITH {v.CONTROLLERS}, f AS (
  SELECT scenario_id, unnest(regexp_extract_all(behavior_tree, '--([A-Za-z]+[0-9]*)\\s+(\\S+)', 1)) AS flag,
    unnest(regexp_extract_all(behavior_tree, '--([A-Za-z]+[0-9]*)\\s+(\\S+)', 2)) AS value,
    unnest(range(len(regexp_extract_all(behavior_tree, '--[A-Za-z]+[0-9]*\\s+\\S+')))) AS pos FROM controllers)
SELECT scenario_id, CAST(pos AS INTEGER) AS pos, flag, CAST(value AS DOUBLE) AS value FROM f""")
def bt_tokens(spark, folder):
    rows = ctl.tokens(v.controllers(spark, folder), "behavior_tree")
    return rows.select("scenario_id", "pos", "flag", "value")


MOST = 6  # branches of the controllers taken apart; the grammar allows four


def _node_sql(i: int) -> str:
    cond, act = f"(p_partkey + {i}) % 6", f"(p_partkey // 7 + {i}) % 6"
    decimal = f"(p_partkey + {i}) % 6 + 0.25"
    base = f"FROM part WHERE p_partkey % 23 <> 0 AND p_size % {MOST} >= {i}"
    return f"""
SELECT p_partkey AS scenario_id, {i} AS branch, 'condition' AS role, CAST({cond} AS INTEGER) AS code,
  CAST(CASE WHEN {cond} IN (3, 4) THEN p_partkey % 10 + 1 ELSE ((p_partkey * {i + 3}) % 1000) / 1000.0 END AS DOUBLE) AS p,
  CAST(CASE WHEN {cond} IN (3, 4) THEN p_partkey % 25 END AS DOUBLE) AS w,
  CAST(NULL AS DOUBLE) AS rwm, CAST(NULL AS DOUBLE) AS att, CAST(NULL AS DOUBLE) AS rep {base}
UNION ALL SELECT p_partkey, {i}, 'action', CAST({act} AS INTEGER), 0.0, NULL,
  CASE WHEN {act} = 0 THEN (p_partkey * {i + 1}) % 110 END, CASE WHEN {act} = 4 THEN {decimal} END,
  CASE WHEN {act} = 5 THEN {decimal} END {base}"""


@query("bt_nodes", " UNION ALL ".join(_node_sql(i) for i in range(MOST)))
def bt_nodes(spark, folder):
    return ctl.nodes(v.controllers(spark, folder, MOST), "scenario_id", "behavior_tree")


def _branch_ok(i: int) -> str:
    cond, act = f"(p_partkey + {i}) % 6", f"(p_partkey // 7 + {i}) % 6"
    return f"""(p_size % 4 < {i} OR (
  ({cond} NOT IN (3, 4) OR p_partkey % 25 <= 20)
  AND ({act} <> 0 OR (p_partkey * {i + 1}) % 110 BETWEEN 1 AND 100)
  AND ({act} NOT IN (4, 5) OR (p_partkey + {i}) % 6 BETWEEN 1 AND 4)))"""


@query("bt_valid", f"""
SELECT p_partkey AS scenario_id, p_partkey % 23 <> 0 AND p_partkey % 29 <> 0
  AND {' AND '.join(_branch_ok(i) for i in range(4))} AS valid FROM part""")
def bt_valid(spark, folder):
    trees = v.controllers(spark, folder)
    checked = ctl.grammar_problems(trees, "behavior_tree", ctl.default_grammar())
    return checked.select("scenario_id", (F.size("problems") == 0).alias("valid"))


def _branch_of_tree(i: int) -> str:
    cond, act = f"(p_partkey + {i}) % 6", f"(p_partkey // 7 + {i}) % 6"
    return f"""(p_size % 4 < {i} OR (
  ({cond} NOT IN (3, 4) OR p_partkey % 25 <= 20) AND {act} <> 0
  AND ({act} NOT IN (4, 5) OR (p_partkey + {i}) % 6 BETWEEN 1 AND 4)))"""


@query("bt_valid_tree", f"""
SELECT p_partkey AS scenario_id, p_partkey % 23 <> 0 AND p_partkey % 29 <> 0 AND p_size % 4 <= 2
  AND {' AND '.join(_branch_of_tree(i) for i in range(3))} AS valid FROM part""")
def bt_valid_tree(spark, folder):
    trees = v.controllers(spark, folder)
    checked = ctl.grammar_problems(trees, "behavior_tree", ctl.tree_grammar())
    return checked.select("scenario_id", (F.size("problems") == 0).alias("valid"))


# --- XML ---------------------------------------------------------------------------------------


@query("xml_target", """
SELECT s_suppkey AS scenario_id, CASE WHEN s_suppkey % 17 <> 0 AND s_suppkey % 4 = 0 THEN 'black' END AS target_color FROM supplier""")
def xml_target(spark, folder):
    return xmlconfig.target_color(v.configurations(spark, folder), "configuration", "scenario_id")


@query("xml_objective", f"""
WITH {v.CONFIGURATIONS}
SELECT scenario_id, CASE kind WHEN 0 THEN 'aggregation' WHEN 1 THEN 'connection' WHEN 2 THEN 'distribution' ELSE 'foraging' END AS kind,
  CASE WHEN kind = 0 THEN 'black' END AS target_color, CASE WHEN kind = 0 THEN CAST('0.' || r AS DOUBLE) END AS radius,
  CASE WHEN kind = 1 THEN 'white' END AS conn_start, CASE WHEN kind = 1 THEN 'black' END AS conn_end,
  CASE WHEN kind = 1 THEN CAST('0.' || r AS DOUBLE) WHEN kind = 2 THEN 0.2 END AS connection_range,
  CASE WHEN kind = 2 THEN CAST(r AS DOUBLE) END AS area_w, CASE WHEN kind = 2 THEN CAST(2.5 AS DOUBLE) END AS area_h,
  CASE WHEN kind = 3 THEN 'black' END AS source, CASE WHEN kind = 3 THEN 'white' END AS sink FROM configs""")
def xml_objective(spark, folder):
    return xmlconfig.objectives(v.configurations(spark, folder), "configuration", "scenario_id")


@query("xml_circles", f"""
WITH {v.CONFIGURATIONS}
SELECT scenario_id, 0 AS circle_no, CAST(cx AS DOUBLE) AS x, CAST(cy AS DOUBLE) AS y, CAST('0.' || r AS DOUBLE) AS radius, 'black' AS color FROM configs
UNION ALL SELECT scenario_id, 1, -1.25, 0.75, 0.36, 'white' FROM configs""")
def xml_circles(spark, folder):
    return xmlconfig.circles(v.configurations(spark, folder), "configuration", "scenario_id")


@query("xml_spawn_circles", f"""
WITH {v.CONFIGURATIONS}
SELECT scenario_id, 0 AS circle_no, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, CAST(0.55 AS DOUBLE) AS radius FROM configs""")
def xml_spawn_circles(spark, folder):
    return xmlconfig.circles(
        v.configurations(spark, folder), "configuration", "scenario_id", "spawnCircle"
    )


@query("xml_rectangles", f"""
WITH {v.CONFIGURATIONS}
SELECT scenario_id, 0 AS rect_no, CAST(cx AS DOUBLE) AS x, CAST(cy || '.25' AS DOUBLE) AS y, CAST('0.' || r AS DOUBLE) AS half_w,
  CAST(0.15 AS DOUBLE) AS half_h, CAST(turn AS DOUBLE) AS angle_deg, 'white' AS color FROM configs""")
def xml_rectangles(spark, folder):
    return xmlconfig.rectangles(v.configurations(spark, folder), "configuration", "scenario_id")


@query("xml_spawn_rectangles", f"""
WITH {v.CONFIGURATIONS}
SELECT scenario_id, 0 AS rect_no, CAST(0.3 AS DOUBLE) AS x, CAST(-0.2 AS DOUBLE) AS y, CAST('0.' || r AS DOUBLE) AS half_w,
  CAST(0.4 AS DOUBLE) AS half_h, CAST(45 AS DOUBLE) AS angle_deg FROM configs""")
def xml_spawn_rectangles(spark, folder):
    return xmlconfig.rectangles(
        v.configurations(spark, folder), "configuration", "scenario_id", "spawnRectangle"
    )


@query("xml_fixed_robots", f"""
WITH {v.CONFIGURATIONS}
SELECT scenario_id, 0 AS robot_no, CAST(cx AS DOUBLE) AS x, CAST(0.5 AS DOUBLE) AS y FROM configs
UNION ALL SELECT scenario_id, 1, 1, 2 FROM configs""")
def xml_fixed_robots(spark, folder):
    return xmlconfig.fixed_robots(v.configurations(spark, folder), "configuration", "scenario_id")


@query("xml_lights", f"""
WITH {v.CONFIGURATIONS}
SELECT scenario_id, 0 AS light_no, 'light_' || scenario_id AS light_id, CAST(cx AS DOUBLE) AS x, CAST(cy || '.5' AS DOUBLE) AS y,
  CAST(0 AS DOUBLE) AS z, CAST(270 AS DOUBLE) AS turn_z, CAST(0 AS DOUBLE) AS turn_y, CAST(0 AS DOUBLE) AS turn_x,
  'yellow' AS color, CAST(r || '.25' AS DOUBLE) AS intensity, 'leds' AS medium FROM configs
UNION ALL SELECT scenario_id, 1, 'extra', NULL, NULL, NULL, 0, 0, 0, 'red', 5, 'leds' FROM configs""")
def xml_lights(spark, folder):
    return xmlconfig.lights(v.configurations(spark, folder), "configuration", "scenario_id")


@query("xml_arena", f"""
WITH {v.CONFIGURATIONS}
SELECT s_suppkey AS scenario_id, CAST(r AS DOUBLE) AS size_x, CAST(r || '.5' AS DOUBLE) AS size_y,
  CASE WHEN r IS NOT NULL THEN CAST(1.95 AS DOUBLE) END AS size_z,
  CAST(NULL AS DOUBLE) AS center_x, CAST(NULL AS DOUBLE) AS center_y, CAST(NULL AS DOUBLE) AS center_z
FROM supplier LEFT JOIN configs ON scenario_id = s_suppkey""")
def xml_arena(spark, folder):
    return xmlconfig.arenas(v.configurations(spark, folder), "configuration", "scenario_id")
