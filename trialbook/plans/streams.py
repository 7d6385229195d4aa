"""Queries that run a stream over a sample table to its end and return the result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trialbook.plans import missions as m
from trialbook.plans import views as v
from trialbook.plans.registry import query
from trialbook.session import checkpoint_folder
from trialbook.streaming import deliveries as sd
from trialbook.streaming import logs as sl


def _run_folder(spark) -> str:
    return f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark, folder, name):
    """A sample table as a file stream."""
    schema = v.table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


STRETCHES = 3


def _arrivals(spark, table, order, into):
    """Write a table's stretches of ``order`` one after the other below ``into``; after each,
    whoever iterates may run its stream over what has arrived."""
    low, high = table.agg(F.min(order), F.max(order)).first()
    if low is None:
        low = high = 0
    step = (high - low) // STRETCHES + 1
    for k in range(STRETCHES):
        stretch = table.where((F.col(order) >= low + k * step) & (F.col(order) < low + (k + 1) * step))
        stretch.write.mode("append").parquet(into)
        yield k


def _arriving(spark, table, into, files=100):
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(into)


_DELIVERIES = f"""
WITH {v.ARENA}, {m._VISITS}
SELECT run_id, robot_id, tick, row_number() OVER (PARTITION BY run_id, robot_id ORDER BY tick) AS delivered
FROM visits WHERE zone = 'sink' AND prev = 'source'"""


@query("stream_foraging", _DELIVERIES)
def stream_foraging(spark, folder):
    at, events = _run_folder(spark), v.table(spark, folder, "events")
    arena = v.floor_circles(spark, folder), v.run_objectives(spark, folder)
    for _ in _arrivals(spark, events, "event_id", f"{at}/in"):
        places = v.robot_positions_of(_arriving(spark, events, f"{at}/in"))
        sd.deliver_batches(places, *arena, f"{at}/out", f"{at}/state", f"{at}/checkpoint")
    return spark.read.schema(sd.OUTPUT).parquet(f"{at}/out").select("run_id", "robot_id", "tick", "delivered")


@query("stream_late", f"""
WITH {v.ARENA}, {m._VISITS}, b AS (SELECT min(event_id) AS lo, (max(event_id) - min(event_id)) // 3 + 1 AS step FROM events),
last AS (SELECT run_id, robot_id, max(tick) AS seen FROM kept, b WHERE tick >= lo + 2 * step OR tick % 10 <> 0 GROUP BY 1, 2)
SELECT k.run_id, k.robot_id, k.tick FROM kept k JOIN last l ON l.run_id = k.run_id AND l.robot_id = k.robot_id, b
WHERE k.tick < lo + 2 * step AND k.tick % 10 = 0 AND k.tick <= seen""")
def stream_late(spark, folder):
    """Every tenth tick of the first two stretches comes after all others."""
    at, events = _run_folder(spark), v.table(spark, folder, "events")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    border = low + 2 * ((high - low) // 3 + 1) if low is not None else 0
    held = (F.col("event_id") < border) & (F.col("event_id") % 10 == 0)
    arena = v.floor_circles(spark, folder), v.run_objectives(spark, folder)
    for part in (events.where(~held), events.where(held)):
        part.write.mode("append").parquet(f"{at}/in")
        places = v.robot_positions_of(_arriving(spark, events, f"{at}/in"))
        sd.deliver_batches(places, *arena, f"{at}/out", f"{at}/state", f"{at}/checkpoint", f"{at}/late")
    late = spark.read.schema("run_id string, robot_id string, tick long, at_source boolean").parquet(f"{at}/late")
    return late.select("run_id", "robot_id", "tick")


@query("stream_foraging_state", _DELIVERIES)
def stream_foraging_state(spark, folder):
    at, events = _run_folder(spark), v.table(spark, folder, "events")
    arena = v.floor_circles(spark, folder), v.run_objectives(spark, folder)
    for _ in _arrivals(spark, events, "event_id", f"{at}/in"):
        places = v.robot_positions_of(_arriving(spark, events, f"{at}/in", files=50))
        sd.run_to_end(sd.stream_deliveries(places, *arena), f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema(sd.OUTPUT).parquet(f"{at}/out").where("delivered is not null")


@query("stream_result_log", f"""
WITH {v.CONTROLLERS} SELECT scenario_id, behavior_tree FROM controllers""")
def stream_result_log(spark, folder):
    """Every scenario has two results in the first files and another one in later files."""
    at = _run_folder(spark)
    trees = v.controllers_of(v.table(spark, folder, "part"))
    tag = F.concat(F.lit("experiment_"), F.col("scenario_id").cast("string"), F.lit(";"))
    first, second, third = (F.concat(tag, F.col("behavior_tree"), F.lit(end)) for end in ("", " --again", " --later"))
    for lines in (F.array(first, second), F.array(third)):
        trees.select(F.explode(lines).alias("value")).write.mode("append").text(f"{at}/in")
        sl.append_results(spark, f"{at}/in", f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema(sl.RESULTS).parquet(f"{at}/out").select("scenario_id", "behavior_tree")


@query("stream_epochs", f"""
WITH b AS (SELECT min(doc_id) AS lo, (max(doc_id) - min(doc_id)) // {STRETCHES} + 1 AS step FROM documents)
SELECT CAST((doc_id - lo) // step AS INTEGER) AS dataset_position, lang AS type, count(*) AS n FROM documents, b GROUP BY 1, 2""")
def stream_epochs(spark, folder):
    at, documents = _run_folder(spark), v.table(spark, folder, "documents").select("doc_id", "lang")
    for _ in _arrivals(spark, documents, "doc_id", f"{at}/in"):
        pairs = _arriving(spark, documents, f"{at}/in").select(
            F.col("doc_id").alias("scenario_id"), F.col("lang").alias("type")
        )
        sl.append_epochs(pairs, f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out").groupBy("dataset_position", "type").agg(
        F.count(F.lit(1)).alias("n")
    )
