"""The measured broadcast and the keyed join beyond it give equal rows."""

from pyspark.sql import functions as F

from tests.conftest import rows
from trialbook.operators.attach import attach, measured_bytes


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_all_ways(spark):
    data = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 50).alias("k"))
    stats = data.groupBy("k").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    planned = attach(data, stats, ["k"])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small, large = attach(data, stats, ["k"]), attach(data, stats, ["k"], limit=0)
        assert "strategy=broadcast" in plan(small)
        assert "strategy=broadcast" not in plan(large)
        found = [rows(d, "id", "k", "lo", "hi") for d in (small, large)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "strategy=broadcast" not in plan(planned)
    assert found[0] == found[1] == rows(planned, "id", "k", "lo", "hi")


def test_null_keys(spark):
    data = spark.createDataFrame([(1, None), (2, "a")], "id int, k string")
    stats = spark.createDataFrame([(None, 5), ("a", 6)], "k string, x int")
    assert rows(attach(data, stats, ["k"]), "id", "x") == [(1, None), (2, 6)]
    assert rows(attach(data, stats, ["k"], null_safe=True), "id", "x") == [(1, 5), (2, 6)]


def test_measured_bytes_count_text(spark):
    one = spark.createDataFrame([("x" * 1000,)], "s string")
    assert 1000 <= measured_bytes(one) <= 1100
    assert measured_bytes(one.filter("false")) == 0
