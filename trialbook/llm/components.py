"""Components of a graph given by links between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialbook.operators.attach import attach
from trialbook.session import pin


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) for every fingerprint in ``edges``; root: the smallest in its component."""
    both = pin(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b"), F.col("a")).toDF("x", "y")))
    labels = pin(both.groupBy("x").agg(F.least("x", F.min("y")).alias("root")).select("x", "root"))
    while True:
        heard = both.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("root").alias("heard"))
        lower = pin(labels.join(heard, "x").select("x", F.least("root", "heard").alias("new"), "root"))
        # a root that some member left for a smaller one tells all that still name it
        told = lower.where("new < root").groupBy("root").agg(F.min("new").alias("told"))
        moved = attach(lower, told, ["root"]).select("x", F.least("new", "told").alias("new"), "root")
        above = moved.select(F.col("x").alias("of"), F.col("new").alias("beyond"))
        step = pin(moved.join(above, F.col("new") == F.col("of"), "left").select("x", F.least("new", "beyond").alias("root"), F.col("root").alias("was")))
        if step.where("root < was").isEmpty():
            return step.select(F.col("x").alias("fp"), "root")
        labels = step.select("x", "root")
