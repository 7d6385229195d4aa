"""Session set-up and the one way this package cuts lineage."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "trialbook", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; ``conf`` overrides (dots as ``__``)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a temporary one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="trialbook-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system its path names; nothing if it is not there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


_pinned: list[str] = []


def clear_pinned(spark: SparkSession) -> int:
    """Delete the tables that ``pin`` has written in this process, and return their number.

    Call it when a run's results have been written; DataFrames built on them end with it.
    """
    for path in _pinned:
        remove(spark, path)
    done = len(_pinned)
    _pinned.clear()
    return done


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables pinned inside when it ends, but for those pinned with the function it yields."""
    start, kept = len(_pinned), []

    def keep(df: DataFrame) -> DataFrame:
        df = pin(df)
        kept.append(_pinned[-1])
        return df

    try:
        yield keep
    finally:
        for path in set(_pinned[start:]).difference(kept):
            remove(spark, path)
        _pinned[start:] = kept


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for what is set up and run inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def released_shuffles(spark: SparkSession):
    """Queries set up and run inside delete their shuffle files as soon as they have ended; a
    stage that is needed once more is run again."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def pin(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Later stages then read equal rows whatever is recomputed or lost, take only the
    columns they need, and the planner knows the size of what it reads. The shuffle files
    of the write are deleted with its end.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/pinned-{uuid.uuid4().hex}"
    _pinned.append(path)
    with released_shuffles(spark):
        df.write.partitionBy(*(partition_by or [])).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small fixed table as a plan constant, so the planner knows its size."""
    text = F.lit(json.dumps(rows))
    return spark.range(1).select(F.inline(F.from_json(text, f"array<struct<{schema}>>")))
