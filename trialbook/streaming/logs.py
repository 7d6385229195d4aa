"""Streams of the append-only result log and of finished epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialbook.sources.logs import parse_result_log


RESULTS = "scenario_id long, behavior_tree string, finished timestamp, batch int"


def append_results(
    spark: SparkSession, folder: str, target: str, checkpoint: str,
    files_per_batch: int | None = None, remember: int | None = None,
) -> None:
    """Store the first result of every scenario in the log files of ``folder``, until all are read.

    First is by the file's time, its path, then the line. A scenario of an earlier micro-batch
    keeps its result. The stored ids are the only state, read as one column; with ``remember``
    only those of so many micro-batches before, and a scenario that comes again after them is
    stored once more. A micro-batch that is run again after a failure overwrites its own folder.
    """
    place = ["_time", "_path", "_block", "_line"]
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    about = [F.col(f"_metadata.file_{c}").alias(n) for c, n in zip(("modification_time", "path", "block_start"), place)]

    def write(batch: DataFrame, number: int) -> None:
        # a block of a file is read by one task from its beginning on, so these numbers rise with its lines
        lines = batch.withColumn("_line", F.monotonically_increasing_id())
        found = parse_result_log(lines, keep=tuple(place)).groupBy("scenario_id")
        first = found.agg(F.min_by(F.struct("behavior_tree", "_time"), F.struct(*place)).alias("_r"))
        first = first.select("scenario_id", "_r.behavior_tree", F.col("_r._time").alias("finished"))
        since = 0 if remember is None else max(0, number - remember)
        if number > since:
            spark_ = batch.sparkSession
            stored = spark_.read.schema(RESULTS).parquet(target).where(F.col("batch").between(since, number - 1))
            first = first.join(stored.select("scenario_id"), "scenario_id", "left_anti")
        first.write.mode("overwrite").parquet(f"{target}/batch={number}")

    started = (
        reader.load(folder).select("value", *about).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()


def append_epochs(pairs: DataFrame, target: str, checkpoint: str, position: str = "dataset_position") -> None:
    """Append each micro-batch of new pairs as one epoch.

    The batch number is the epoch. A batch that is run again after a failure overwrites
    its own partition, so no epoch is stored twice and the earlier ones are never rewritten.
    """

    def write(batch: DataFrame, number: int) -> None:
        tagged = batch.withColumn(position, F.lit(number))
        (
            tagged.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(position)
            .parquet(target)
        )

    started = (
        pairs.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
