"""Places where a caller's model or scorer plugs in, in batches.

``load`` runs once per task and returns the function for its batches, so a model is
loaded once and not once per row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def map_generate(
    df: DataFrame,
    load: Callable[[], Callable[[pd.Series], pd.Series]],
    source: str,
    out: str,
    partitions: int | None = None,
) -> DataFrame:
    """Add a text column made by a batch function of another text column."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = load()
        for batch in batches:
            yield batch.assign(**{out: generate(batch[source])})

    spread = df.repartition(partitions) if partitions else df
    return spread.mapInPandas(run, schema)


def map_score(
    df: DataFrame,
    load: Callable[[], Callable[[pd.DataFrame, pd.Series], pd.Series]],
    key: str,
    inputs: list[str],
    repeats: int = 10,
    partitions: int | None = None,
    skip_empty: str | None = None,
) -> DataFrame:
    """Score each row ``repeats`` times; one row per run with NULL where the run failed.

    The scorer gets the input columns and the repeat number of a batch. Rows whose
    ``skip_empty`` column is missing or empty are not scored.
    """
    kept = df if skip_empty is None else df.filter(F.length(F.col(skip_empty)) > 0)
    runs = kept.select(*dict.fromkeys([key, *inputs])).withColumn(
        "repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    )
    if partitions:
        runs = runs.repartition(partitions)
    schema = T.StructType(
        [
            df.schema[key],
            T.StructField("repeat", T.IntegerType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for batch in batches:
            values = score(batch[inputs], batch["repeat"])
            yield pd.DataFrame(
                {key: batch[key], "repeat": batch["repeat"], "score": values.astype("float64")}
            )

    return runs.mapInPandas(run, schema)


def collect_scores(
    runs: DataFrame, key: str, score: str = "score", repeat: str = "repeat",
    scores: str = "scores", average: str = "avg_score",
) -> DataFrame:
    """One score array per key in repeat order, failed runs dropped, with its mean.

    The array is the stored form of a scenario's repeated scores; its length is the
    number of repeats. Means alone should be aggregated without it.
    """
    known = F.col(score).isNotNull()
    ordered = F.array_sort(F.collect_list(F.when(known, F.struct(repeat, score))))
    return runs.groupBy(key).agg(
        F.transform(ordered, lambda s: s[score]).alias(scores),
        F.avg(score).alias(average),
    )
