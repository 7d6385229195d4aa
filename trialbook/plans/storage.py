"""Queries that write to a fresh folder, read back and return what was read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trialbook.plans import views as v
from trialbook.plans.registry import query
from trialbook.session import checkpoint_folder
from trialbook.sources import datasets, logs


def _fresh(spark, name):
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("write_dataset", """
SELECT o_orderkey AS scenario_id, o_orderpriority AS type, o_totalprice AS score FROM orders""")
def write_dataset(spark, folder):
    rows = v.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("scenario_id"), F.col("o_orderpriority").alias("type"), F.col("o_totalprice").alias("score")
    )
    at = _fresh(spark, "dataset")
    datasets.write_dataset(rows, at, ["type"])
    return datasets.read_dataset(spark, at).select("scenario_id", "type", "score")


@query("training_shards", "SELECT md5(text) AS digest, count(*) AS n FROM documents GROUP BY 1")
def training_shards(spark, folder):
    at = _fresh(spark, "shards")
    datasets.write_training_shards(v.table(spark, folder, "documents"), at, "text", shards=8)
    return spark.read.parquet(at).groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query("export_folders", """
SELECT 'experiment_' || s_suppkey AS dirname, '<mission name="' || s_name || '"/>' || chr(10) AS mission,
  CAST(s_nationkey AS VARCHAR) AS kind FROM supplier""")
def export_folders(spark, folder):
    rows = v.table(spark, folder, "supplier").select(
        "s_suppkey", F.concat(F.lit('<mission name="'), "s_name", F.lit('"/>\n')).alias("mission"), F.col("s_nationkey").cast("string").alias("kind")
    )
    at = _fresh(spark, "export")
    datasets.export_folders(rows, at, "s_suppkey", "mission", "kind")
    return datasets.read_folders(spark, at)


@query("training_log", """
SELECT 'train' AS series, CAST(event_id / 100.0 AS DOUBLE) AS epoch, value FROM events WHERE event_type <> 'view'
UNION ALL SELECT 'eval', CAST(event_id / 100.0 AS DOUBLE), value FROM events WHERE event_type = 'view'""")
def training_log(spark, folder):
    lines = v.table(spark, folder, "events").select(
        F.to_json(
            F.struct(
                F.expr("CAST(event_id / 100.0 AS DOUBLE)").alias("epoch"),
                F.when(F.col("event_type") != "view", F.col("value")).alias("loss"),
                F.when(F.col("event_type") == "view", F.col("value")).alias("eval_loss"),
            )
        ).alias("value")
    )
    at = _fresh(spark, "log")
    lines.write.text(at)
    return logs.log_series(logs.read_training_log(spark, at))
