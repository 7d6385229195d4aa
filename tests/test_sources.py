"""Files in, files out, logs, XML and streams."""

import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from trialbook.operators import hooks, xmlconfig
from trialbook.operators.fitness import deliveries
from trialbook.plans import catalog
from trialbook.session import checkpoint_folder, pin
from trialbook.sources import datasets, logs
from trialbook.streaming import deliveries as sd
from trialbook.streaming import logs as sl


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0, [0.5]), (2, float("nan"), None)], "i int, x double, a array<double>")
    datasets.write_dataset(df, f"{tmp_path}/d")
    datasets.write_dataset(df, f"{tmp_path}/d")
    assert rows(datasets.read_dataset(spark, f"{tmp_path}/d"), "i", "x") == [(1, 1.0), (2, None)]


def test_tagged_folder(spark, tmp_path):
    pd.DataFrame({"x": [1.0, 2.0]}).to_parquet(tmp_path / "run_225.parquet")
    pd.DataFrame({"x": [3.0]}).to_parquet(tmp_path / "run_450.parquet")
    (tmp_path / "notes.txt").write_text("no data")
    got = rows(datasets.read_tagged(spark, str(tmp_path), "x double"), "x", "Dataset")
    assert got == [(1.0, "run_225.parquet"), (2.0, "run_225.parquet"), (3.0, "run_450.parquet")]


def test_tagged_folders_of_files(spark, tmp_path):
    """Datasets written by Spark are folders; a name may hold what a path encodes."""
    at = tmp_path / "some runs"
    spark.range(4).selectExpr("CAST(id AS double) AS x").repartition(3).write.parquet(f"{at}/run a+1%.parquet")
    spark.range(1).selectExpr("9.0D AS x").write.parquet(f"{at}/_draft.parquet")
    pd.DataFrame({"x": [7.0]}).to_parquet(at / "run_b.parquet")
    got = rows(datasets.read_tagged(spark, str(at), "x double"), "x", "Dataset")
    assert got == [*((float(i), "run a+1%.parquet") for i in range(4)), (7.0, "run_b.parquet")]
    assert datasets.read_tagged(spark, str(at), "x double", suffix="run_c*").columns == ["x", "Dataset"]
    assert datasets.read_tagged(spark, str(at), "x double", suffix="run_c*").count() == 0


def test_tagged_query_on_folders(spark, small, tmp_path):
    for name in ("documents", "benchmark", "conversations"):
        spark.read.parquet(f"{small}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    query = catalog.QUERIES["read_tagged_several"]
    assert rows(query(spark, str(tmp_path)), "dataset", "n", "n_lang", "n_turn", "chars") == rows(query(spark, small), "dataset", "n", "n_lang", "n_turn", "chars")


def test_export_and_shards(spark, tmp_path):
    df = spark.createDataFrame([(7, "<a/>\nline", "Foraging")], "i int, m string, t string")
    assert datasets.export_folders(df, str(tmp_path / "e"), "i", "m", "t") == 1
    folder = tmp_path / "e" / "experiment_7"
    assert (folder / "experiments-folder" / "mission.argos").read_bytes() == b"<a/>\nline"
    assert (folder / "mission_type.txt").read_bytes() == b"Foraging"
    assert rows(datasets.read_folders(spark, str(tmp_path / "e"))) == [("experiment_7", "<a/>\nline", "Foraging")]
    datasets.write_training_shards(df.withColumnRenamed("m", "text"), str(tmp_path / "s"), shards=2)
    assert spark.read.parquet(str(tmp_path / "s")).columns == ["text"]


def test_row_lookup(spark):
    df = spark.createDataFrame([(1, "a")], "i int, argos string")
    assert datasets.row_lookup(df, "i", 1, ["argos", "llm_behavior_tree"]).columns == ["i", "argos"]
    assert datasets.row_lookup(df, "i", 5, ["argos"]).count() == 0


def test_result_log(spark, tmp_path):
    path = tmp_path / "out.txt"
    path.write_text("experiment_20;\n\nexperiment_38; --nroot 3 \n")
    assert rows(logs.read_result_log(spark, str(path))) == [(20, ""), (38, "--nroot 3")]
    path.write_text("experiment_1;a;b\n")
    with pytest.raises(Exception, match="not two parts"):
        logs.read_result_log(spark, str(path)).collect()


def test_score_rules(spark):
    lines = ["x", "Score 1e-05", "Score -2.5"]
    df = spark.createDataFrame([("r", i, t) for i, t in enumerate(lines)], "run string, n int, t string")
    assert rows(logs.first_score(df, "run", "n", "t"), "score") == [(1.0,)]
    assert rows(logs.last_score(df, "run", "n", "t"), "score") == [(2.5,)]
    bad = spark.createDataFrame([("r", 0, "Score none")], "run string, n int, t string")
    assert rows(logs.first_score(bad, "run", "n", "t"), "score") == [(None,)]
    with pytest.raises(Exception, match="not a number"):
        logs.last_score(bad, "run", "n", "t").collect()


def test_training_log(spark, tmp_path):
    entries = [{"loss": 1.5, "epoch": 0.5}, {"eval_loss": 1.2, "epoch": 1.0}, {"train_runtime": 9.0, "total_flos": 3.0, "epoch": 1.0}]
    (tmp_path / "log.json").write_text("\n".join(json.dumps(e) for e in entries))
    log = logs.read_training_log(spark, str(tmp_path / "log.json"))
    assert rows(logs.log_series(log), "series", "epoch", "value") == [("eval", 1.0, 1.2), ("train", 0.5, 1.5)]
    assert dict(rows(logs.final_metrics(log)))["total_flos"] == 3.0


CONFIG = """<?xml version="1.00" ?>
<config><env-elems>
 <light id="lamp" position="0.75,-1.25,0.50" orientation="180,0,0" color="yellow" intensity="7.50" medium="leds"/>
 <arena-attrib size="3.10,2.90,1.75"/></env-elems>
 <objective-elems><spawnCircle position="0.2,0.1" radius="0.6"/>
 <circle position="0.75,-1.25" radius="0.21" color="black"/><circle position="-1.4,0.9" radius="0.37" color="white"/>
 <rectangle center="0.5,0.5" angle="30" width="0.2" height="0.1" color="white"/><rectangle center="-0.6,1.1" angle="115" width="0.4" height="0.3" color="black"/>
 <epuck position="0.1,0.2"/><epuck position="-0.7,0.9"/>
 <objective type="aggregation"><objective-params target-color="black" radius="0.21"/></objective>
 </objective-elems></config>"""
SIMULATOR = """<?xml version="1.00" ?>
<argos-configuration><loop_functions library="x" label="template"><circle position="-0.35,0.85" radius="0.52" color="white"/>
 <objective type="connection"><objective-params conn_start="white" conn_end="black" connection_range="0.3"/></objective></loop_functions>
 <arena size="4.20,3.60,1.50" center="0,0,0"><light id="ceiling" position="0,0,1" orientation="0,0,0" color="red" intensity="2.25" medium="leds"/></arena>
</argos-configuration>"""


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(1, CONFIG), (2, SIMULATOR), (3, "<config><a"), (4, None)], "k int, d string")


def test_xml(documents):
    assert rows(xmlconfig.target_color(documents, "d", "k")) == [(1, "black"), (2, None), (3, None), (4, None)]
    assert rows(xmlconfig.objectives(documents, "d", "k"), "k", "kind", "radius", "connection_range") == [
        (1, "aggregation", 0.21, None), (2, "connection", None, 0.3),
    ]
    assert rows(xmlconfig.circles(documents, "d", "k"), "k", "circle_no", "x", "radius", "color") == [
        (1, 0, 0.75, 0.21, "black"), (1, 1, -1.4, 0.37, "white"), (2, 0, -0.35, 0.52, "white"),
    ]
    assert rows(xmlconfig.circles(documents, "d", "k", "spawnCircle"), "k", "radius") == [(1, 0.6)]
    assert rows(xmlconfig.rectangles(documents, "d", "k"), "half_w", "angle_deg", "color") == [(0.2, 30.0, "white"), (0.4, 115.0, "black")]
    assert rows(xmlconfig.fixed_robots(documents, "d", "k"), "x", "y") == [(-0.7, 0.9), (0.1, 0.2)]
    assert rows(xmlconfig.lights(documents, "d", "k"), "k", "light_id", "intensity") == [(1, "lamp", 7.5), (2, "ceiling", 2.25)]
    assert rows(xmlconfig.arenas(documents, "d", "k"), "k", "size_x", "center_x")[:2] == [(1, 3.1, None), (2, 4.2, 0.0)]


def test_hooks_load_once_per_task(spark):
    def load():
        calls = {"n": 0}

        def generate(texts):
            calls["n"] += 1
            return texts + f"-{calls['n']}"

        return generate

    df = spark.createDataFrame([(i, "t") for i in range(20)], "i int, s string").coalesce(1)
    assert {r["o"] for r in hooks.map_generate(df, load, "s", "o").collect()} == {"t-1"}

    def scorer():
        return lambda batch, repeat: (batch["i"] + repeat).where(repeat != 1)

    runs = hooks.map_score(df, scorer, "i", ["i", "s"], repeats=3)
    got = {r["i"]: (r["scores"], r["avg_score"]) for r in hooks.collect_scores(runs, "i").collect()}
    assert got[4] == ([4.0, 6.0], 5.0) and len(got) == 20


def positions_in_files(spark, tmp_path, files):
    """Random zone visits of six robots, one of them busy, as one file per stretch of ticks."""
    rng = random.Random(9)
    at = {"source": (0.0, 0.0), "sink": (4.0, 0.0), "none": (9.0, 9.0), "both": (2.0, 0.0)}
    data = [("r", str(robot), t, *at[rng.choice(list(at))]) for robot in range(6) for t in range(300 if robot == 0 else 50)]
    rng.shuffle(data)
    places = spark.createDataFrame(data, "run_id string, robot_id string, tick int, x double, y double")
    for i in range(files):
        part = places.filter((F.col("tick") >= i * 20) & ((F.col("tick") < (i + 1) * 20) | F.lit(i == files - 1)))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return places


class Held:
    """A group's state as the step sees it."""

    def __init__(self, value=None):
        self.get, self.exists = value, value is not None

    def update(self, value):
        self.get, self.exists = value, True


def test_step_makes_no_frame_without_deliveries_or_late_ticks():
    def frame(ticks, zone):
        return pd.DataFrame({"run_id": "r", "robot_id": "7", "tick": ticks, "at_source": zone})

    state = Held()
    assert list(sd._step(("r", "7"), iter([frame([5, 3], [True, False])]), state)) == [] and state.get == (True, 0, 5)
    (found,) = sd._step(("r", "7"), iter([frame([9, 4], [False, True]), frame([8, 10, 5], [True, False, False])]), state)
    assert [tuple(r) for r in found.astype(object).where(found.notna(), None).to_numpy()] == [("r", "7", 9, 1), ("r", "7", 4, None), ("r", "7", 5, None)]
    assert state.get == (False, 1, 10)


@pytest.mark.parametrize("way", ["state store", "batches"])
def test_stream_matches_batch_over_several_micro_batches(spark, tmp_path, way):
    batch = positions_in_files(spark, tmp_path, 3)
    floor = spark.createDataFrame(
        [("r", 0, 0.0, 0.0, 2.5, "black"), ("r", 1, 4.0, 0.0, 2.5, "white")],
        "run_id string, circle_no int, x double, y double, radius double, color string",
    )
    goals = spark.createDataFrame([("r", "foraging", "black", "white")], "run_id string, kind string, source string, sink string")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    if way == "batches":
        sd.deliver_batches(stream, floor, goals, out, str(tmp_path / "state"), str(tmp_path / "cp"))
    else:
        sd.run_to_end(sd.stream_deliveries(stream, floor, goals), out, str(tmp_path / "cp"))
    found = spark.read.schema(sd.OUTPUT).parquet(out)
    got = rows(found.groupBy("run_id", "robot_id").agg(F.max("delivered"), F.count(F.lit(1))))
    want = [r for r in rows(deliveries(batch, floor, goals), "run_id", "robot_id", "delivered") if r[2] > 0]
    assert [g[:3] for g in got] == want and all(g[2] == g[3] for g in got)
    assert sum(g[3] for g in got) > 10


def test_a_robot_with_most_ticks_is_many_stretches(spark):
    """Deliveries and states by composition, over two batches, against a walk through the ticks."""
    rng = random.Random(4)
    ticks = {("r", str(k)): sorted(rng.sample(range(100_000), 6000 if k == 0 else 40)) for k in range(200)}
    data = [(*robot, t, rng.random() < 0.5) for robot, at in ticks.items() for t in at]
    df = pin(spark.createDataFrame(data, "run_id string, robot_id string, tick long, at_source boolean"))
    prior = spark.createDataFrame([], sd.ROBOT_STATE)
    got = {}
    for part in (df.where("tick < 50000"), df.where("tick >= 50000")):
        found = sd.stretches(part).cache()
        whole = sd.composed(found.where("summary"), prior).cache()
        shares = [r[1] for r in found.where("summary").groupBy(sd.CHUNK).agg(F.sum("ticks")).collect()]
        assert max(shares) <= 2 * sorted(shares)[len(shares) // 2] and sum(shares) == part.count()
        assert whole.where("robot_id = '0'").count() > 2
        inside = found.where("not summary").join(whole.select(*sd.ROBOT, sd.CHUNK, "_base", "_first"), [*sd.ROBOT, sd.CHUNK])
        for r in inside.collect():
            got[r["robot_id"], r["tick"]] = r["_base"] + r["_first"] + r["n"]
        for r in whole.where("_first = 1").collect():
            got[r["robot_id"], r["tick"]] = r["_base"] + 1
        last = whole.groupBy(*sd.ROBOT).agg(F.max_by(F.struct("last_tick", "last_at_source", "_base", "_first", "n"), sd.CHUNK).alias("s"))
        prior = last.select(*sd.ROBOT, F.col("s.last_tick").alias("tick"), F.col("s.last_at_source").alias("at_source"), F.expr("s._base + s._first + s.n").alias("delivered"))
    want, zone, count = {}, {}, {}
    for _, robot, tick, source in sorted(data):
        if not source and zone.get(robot):
            count[robot] = want[robot, tick] = count.get(robot, 0) + 1
        zone[robot] = source
    assert got == want


def results_of(spark, folder):
    return rows(spark.read.schema(sl.RESULTS).parquet(folder), "scenario_id", "behavior_tree")


@pytest.mark.parametrize("files", [1, None])
def test_first_result_by_file_and_line(spark, tmp_path, files):
    (tmp_path / "in").mkdir()
    texts = {"b": "experiment_2;x\nexperiment_1;\nexperiment_2;other\n", "a": "experiment_2;late\n\nexperiment_3;y\nexperiment_1;late\n"}
    for at, (name, text) in enumerate(texts.items()):
        (tmp_path / "in" / f"{name}.txt").write_text(text)
        os.utime(tmp_path / "in" / f"{name}.txt", (1e9 + at, 1e9 + at))
    args = spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), files
    sl.append_results(*args)
    assert results_of(spark, args[2]) == [(1, ""), (2, "x"), (3, "y")]
    (tmp_path / "in" / "c.txt").write_text("experiment_1;again\nexperiment_4;z\n")
    sl.append_results(*args)
    assert results_of(spark, args[2]) == [(1, ""), (2, "x"), (3, "y"), (4, "z")]


def test_results_are_remembered_for_some_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for at, text in enumerate(["experiment_1;a", "experiment_1;b\nexperiment_2;c", "experiment_1;d"]):
        (tmp_path / "in" / f"{at}.txt").write_text(text + "\n")
        sl.append_results(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), remember=1)
    assert results_of(spark, str(tmp_path / "out")) == [(1, "a"), (1, "d"), (2, "c")]


def test_epochs_append_and_are_not_stored_twice(spark, tmp_path):
    source = tmp_path / "in"
    spark.range(3).coalesce(1).write.parquet(str(source))

    def run(checkpoint):
        stream = spark.readStream.schema("id long").parquet(str(source))
        sl.append_epochs(stream, str(tmp_path / "out"), checkpoint)

    run(str(tmp_path / "cp"))
    spark.range(10, 12).coalesce(1).write.mode("append").parquet(str(source))
    run(str(tmp_path / "cp"))
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert rows(stored.groupBy("dataset_position").count()) == [(0, 3), (1, 2)]


def test_checkpoint_folder_is_taken_from_the_session(spark):
    assert checkpoint_folder(spark) == spark.sparkContext.getCheckpointDir()


def test_exported_folders_refuse_repeated_ids(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (1, "c", "y")], "i long, m string, t string")
    with pytest.raises(ValueError, match="2 rows for experiment_1"):
        datasets.export_folders(df, str(tmp_path / "r"), "i", "m", "t")
    assert not (tmp_path / "r").exists()
