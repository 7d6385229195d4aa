"""Result logs, run output and training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAINING_LOG_SCHEMA = (
    "step int, epoch double, loss double, eval_loss double, train_runtime double, "
    "train_samples_per_second double, train_steps_per_second double, total_flos double"
)


def parse_result_log(lines: DataFrame, text: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """``experiment_<id>;<controller>`` lines as rows; a line with another number of parts is an error.

    Blank lines are skipped and an empty controller is kept as ''. ``keep``: columns that stay.
    """
    kept = lines.filter(F.length(F.trim(F.col(text))) > 0)
    parts = F.split(F.trim(F.col(text)), ";")
    bad = F.raise_error(F.concat(F.lit("not two parts: "), F.col(text)))
    id_text = F.regexp_extract(parts[0], r"^[^_]*_(\d+)", 1)
    return kept.select(
        F.when(F.size(parts) == 2, id_text.cast("long")).otherwise(bad.cast("long")).alias("scenario_id"),
        F.trim(F.try_element_at(parts, F.lit(2))).alias("behavior_tree"),
        *keep,
    )


def read_result_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_result_log(spark.read.text(path))


def first_score(lines: DataFrame, run: str, line_no: str, text: str) -> DataFrame:
    """Score of the first line starting with ``Score``: its first plain number, no exponent."""
    hits = lines.filter(F.col(text).startswith("Score"))
    first = hits.groupBy(run).agg(F.min_by(text, line_no).alias("_t"))
    number = F.nullif(F.regexp_extract("_t", r"-?\d+(\.\d+)?", 0), F.lit(""))
    return first.select(run, number.cast("double").alias("score"))


def last_score(lines: DataFrame, run: str, line_no: str, text: str, sign: int = -1) -> DataFrame:
    """Score of the last line holding ``Score``, exponent included, times ``sign``.

    A line without a number is an error.
    """
    hits = lines.filter(F.col(text).contains("Score"))
    last = hits.groupBy(run).agg(F.max_by(text, line_no).alias("_t"))
    number = F.regexp_extract("_t", r"Score ([-+0-9.e]+)", 1).try_cast("double")
    bad = F.raise_error(F.concat(F.lit("not a number: "), F.col("_t"))).cast("double")
    return last.select(run, (F.coalesce(number, bad) * sign).alias("score"))


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRAINING_LOG_SCHEMA).json(path)


def log_series(log: DataFrame) -> DataFrame:
    """Training and evaluation loss as (series, epoch, value) rows."""
    return (
        log.select("epoch", F.col("loss").alias("train"), F.col("eval_loss").alias("eval"))
        .unpivot(["epoch"], ["train", "eval"], "series", "value")
        .filter("value is not null")
    )


def final_metrics(log: DataFrame) -> DataFrame:
    """The closing entry of a log as (metric, value) rows."""
    metrics = [
        "train_runtime", "train_samples_per_second", "train_steps_per_second", "total_flos",
    ]
    closing = log.filter(F.col("train_runtime").isNotNull()).select(*metrics)
    return closing.unpivot([], metrics, "metric", "value")
