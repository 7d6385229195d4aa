"""Reading, tagging, looking up, writing and exporting stored datasets."""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialbook.functions.scores import clean


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN in float columns becomes NULL, so aggregates skip it as they skip other gaps."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: clean(F.col(c)) for c in floats})


def read_dataset(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return missing_as_null(reader.parquet(path))


def read_tagged(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | str | None = None,
    suffix: str = "*.parquet",
    tag: str = "Dataset",
) -> DataFrame:
    """All datasets of a folder with a matching name, that name in column ``tag``.

    A dataset is a file or a folder of files; names that begin with ``_`` or ``.`` are no
    datasets. The name comes from the scan itself, so one scan reads all datasets and no union
    grows with their number.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    depth = found_below(spark, folder, suffix)
    if depth is None:
        raw, name = reader.option("pathGlobFilter", suffix).parquet(folder), F.lit(None).cast("string")
    else:
        raw = reader.parquet(f"{folder}/{suffix}")
        path = F.regexp_replace("_metadata.file_path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
        name = F.get(F.filter(F.split(path, "/"), lambda n: n != ""), F.lit(depth))
        name = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
        raw = raw.where(~name.rlike("^[_.]"))
    return missing_as_null(raw.select("*", name.alias(tag)))


def found_below(spark: SparkSession, folder: str, names: str) -> int | None:
    """The number of names in the whole path of ``folder``; None if nothing below matches ``names``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, names)):
        return None
    return len([n for n in system.makeQualified(path).toUri().getPath().split("/") if n])


def write_dataset(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_training_shards(df: DataFrame, path: str, text: str = "text", shards: int | None = None) -> None:
    """The text column alone, as Parquet shards for a trainer."""
    only = df.select(text)
    (only.repartition(shards) if shards else only).write.mode("overwrite").parquet(path)


MISSION_FILE, KIND_FILE = "experiments-folder/mission.argos", "mission_type.txt"


def export_folders(df: DataFrame, path: str, key: str, mission: str, kind: str) -> int:
    """One folder ``experiment_<id>`` per row with the mission and its kind; returns their number.

    ``path`` is on a file system that all executors have mounted. Each row's files are
    written by the task that holds the row, in one pass, as UTF-8, first under another name,
    so a task that runs again replaces them whole. NULL text makes an empty file; rows
    without an id and ids that come twice are errors, found before anything is written.
    """
    root = path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path
    if "://" in root:
        raise ValueError("export_folders writes to a mounted file system")
    name = F.concat(F.lit("experiment_"), F.col(key).cast("string"))
    twice = df.where(F.col(key).isNotNull()).groupBy(name.alias("n")).agg(F.count("*").alias("c")).where("c > 1").first()
    if twice is not None:
        raise ValueError(f"{twice['c']} rows for {twice['n']}")
    rows = df.select(F.coalesce(name, F.raise_error(F.lit("row without id")).cast("string")).alias("n"), F.col(mission).alias("m"), F.col(kind).alias("k"))

    def write(batches):
        for batch in batches:
            for folder, text, of in zip(batch["n"], batch["m"], batch["k"]):
                for file, value in ((MISSION_FILE, text), (KIND_FILE, of)):
                    target = os.path.join(root, folder, file)
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    draft = f"{target}.{uuid.uuid4().hex}"
                    with open(draft, "w", encoding="utf-8", newline="") as out:
                        out.write(value or "")
                    os.replace(draft, target)
            yield pd.DataFrame({"n": [len(batch)]})

    return rows.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_folders(spark: SparkSession, path: str) -> DataFrame:
    """What ``export_folders`` wrote, as (dirname, mission, kind)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = files.select(
        F.regexp_extract("path", r"/(experiment_[^/]+)/", 1).alias("dirname"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("f"),
        F.decode("content", "UTF-8").alias("value"),
    )

    def one(file: str, out: str):
        return F.max(F.when(F.col("f") == file.rsplit("/")[-1], F.col("value"))).alias(out)

    return named.groupBy("dirname").agg(one(MISSION_FILE, "mission"), one(KIND_FILE, "kind"))


def row_lookup(df: DataFrame, key: str, value: int, columns: list[str]) -> DataFrame:
    """The row with an id, with those of ``columns`` that exist; none when it is out of range."""
    present = [c for c in columns if c in df.columns]
    return df.filter(F.col(key) == value).select(key, *present)
