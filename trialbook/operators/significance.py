"""Correlation, effect size and paired tests by group.

Everything is a grouped aggregate; ranks come from ``ranked_values``, where equal values
are merged before they are ordered, so rank sums need no join back to the rows. Where groups
and all rows are ranked together, one order serves both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialbook.functions.pvalues import EXACT_PAIRS, t_test_p, wilcoxon_method, wilcoxon_p
from trialbook.operators.ordering import CHUNK, mean_rank, ranged, ranked_values
from trialbook.session import pin


def pearson_by(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    return df.groupBy(*by).agg(F.corr(a, b).alias("correlation"))


def average_ranks(df: DataFrame, by: list[str], value: str, out: str = "avg_rank") -> DataFrame:
    """Average rank of each row's value within its group."""
    ranks = ranked_values(df, by, value).select(*by, value, mean_rank().alias(out))
    return df.join(ranks, [*by, value], "left")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman correlation of two columns over complete rows, as one row.

    Equal pairs are merged first; the correlation is computed from weighted sums.
    """
    both = pin(df.select(a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull()))
    pairs = both.groupBy(a, b).agg(F.count(F.lit(1)).alias("w"))
    long = both.unpivot([], [a, b], "metric", "v")
    ranks = ranked_values(long, ["metric"], "v").select("metric", "v", mean_rank().alias("r"))
    rank_a = ranks.filter(F.col("metric") == a).select(F.col("v").alias(a), F.col("r").alias("ra"))
    rank_b = ranks.filter(F.col("metric") == b).select(F.col("v").alias(b), F.col("r").alias("rb"))
    joined = pairs.join(rank_a, a).join(rank_b, b)
    # ranks have the known mean (n + 1) / 2, so centred sums need one pass
    total = both.agg(((F.count(F.lit(1)) + 1) / F.lit(2.0)).alias("m")).scalar()
    da, db, w = F.col("ra") - total, F.col("rb") - total, F.col("w")
    return joined.agg(
        F.sum(w).alias("n"),
        F.try_divide(
            F.sum(w * da * db), F.sqrt(F.sum(w * da * da)) * F.sqrt(F.sum(w * db * db))
        ).alias("spearman"),
    )


def _moments(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(a).alias("n_a"),
        F.count(b).alias("n_b"),
        F.avg(a).alias("mean_a"),
        F.avg(b).alias("mean_b"),
        F.var_samp(a).alias("_va"),
        F.var_samp(b).alias("_vb"),
    )


def _merged(moments: DataFrame) -> DataFrame:
    """The moments of all rows from those of their groups, as one row."""
    squares = {}
    for s in "ab":
        n, mean = F.col(f"n_{s}"), F.col(f"mean_{s}")
        inner = F.coalesce(F.col(f"_v{s}"), F.lit(0.0)) * F.greatest(n - 1, F.lit(0))
        squares[f"_q{s}"] = F.sum(inner)
        squares[f"_s{s}"] = F.sum(n * mean)
        squares[f"_c{s}"] = F.sum(n)
    sums = moments.agg(*[c.alias(k) for k, c in squares.items()])
    # between the groups: the spread of their means around the mean of all rows
    spread = {
        f"_b{s}": F.sum(F.col(f"n_{s}") * F.pow(F.col(f"mean_{s}") - sums.select(F.try_divide(f"_s{s}", f"_c{s}")).scalar(), F.lit(2)))
        for s in "ab"
    }
    total = moments.agg(*[squares[k].alias(k) for k in squares], *[c.alias(k) for k, c in spread.items()])
    columns = []
    for s in "ab":
        n = F.col(f"_c{s}")
        columns += [
            F.coalesce(n, F.lit(0)).alias(f"n_{s}"),
            F.try_divide(F.col(f"_s{s}"), n).alias(f"mean_{s}"),
            F.when(n > 1, (F.col(f"_q{s}") + F.coalesce(F.col(f"_b{s}"), F.lit(0.0))) / (n - 1)).alias(f"_v{s}"),
        ]
    return total.select(*columns)


def _effects(moments: DataFrame) -> DataFrame:
    n_a, n_b = F.col("n_a"), F.col("n_b")
    pooled = F.sqrt(
        F.try_divide((n_a - 1) * F.col("_va") + (n_b - 1) * F.col("_vb"), n_a + n_b - 2)
    )
    with_sd = moments.withColumn("pooled_sd", pooled).withColumn("dof", n_a + n_b - 2)
    error = F.col("pooled_sd") * F.sqrt(1 / n_a + 1 / n_b)
    return (
        with_sd.withColumn("mean_difference", F.col("mean_b") - F.col("mean_a"))
        .withColumn("cohens_d", F.try_divide(F.col("mean_b") - F.col("mean_a"), F.col("pooled_sd")))
        .withColumn("t", F.try_divide(F.col("mean_a") - F.col("mean_b"), error))
        .drop("_va", "_vb")
    )


def effect_size(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Means, pooled standard deviation, Cohen's d, and the equal-variance t with its df.

    d is (mean b - mean a) / pooled sd; t is (mean a - mean b) over its standard error.
    """
    return _effects(_moments(df, by, a, b))


def t_test_by(df: DataFrame, by: list[str], a: str, b: str, alternative: str = "greater") -> DataFrame:
    stats = effect_size(df, by, a, b)
    return stats.withColumn("t_p", t_test_p(alternative)(F.col("t"), F.col("dof").cast("double")))


def wilcoxon_statistics(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Signed-rank sums per group: n, zeros, W+, W-, and the normal score z."""
    d = F.col(a) - F.col(b)
    diffs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, d.alias("_d"))
    diffs = pin(diffs)
    nonzero = diffs.filter(F.col("_d") != 0).withColumn("_m", F.abs("_d"))
    ranked = ranked_values(
        nonzero,
        by,
        "_m",
        {"_up": F.count(F.when(F.col("_d") > 0, 1)), "_down": F.count(F.when(F.col("_d") < 0, 1))},
    )
    ties = F.col("n").cast("double")
    sums = ranked.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("_up") * mean_rank()).alias("w_plus"),
        F.sum(F.col("_down") * mean_rank()).alias("w_minus"),
        F.sum(ties * ties * ties - ties).alias("_ties"),
    )
    zeros = diffs.groupBy(*by).agg(F.count(F.when(F.col("_d") == 0, 1)).alias("zeros"))
    return _scored(zeros.join(sums, by, "left"))


def _scored(sums: DataFrame) -> DataFrame:
    """Rank sums with ``has_ties`` and the normal score ``z``."""
    n = F.col("n").cast("double")
    mean = n * (n + 1) / 4.0
    variance = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_ties") / 48.0
    return (
        sums.withColumn("has_ties", F.col("_ties") > 0)
        .withColumn(
            "z",
            F.when(variance > 0, F.try_divide(F.col("w_plus") - mean, F.sqrt(F.greatest(variance, F.lit(0.0))))),
        )
        .drop("_ties")
    )


#: Of one part of an order, for a group or all rows (``whole``): pairs, zeros, and pairs up and
#: down with the sums of their ranks within the part.
RANK_SUMS = f"{CHUNK} int, g string, whole boolean, n long, zeros long, up long, down long, up_ranks double, down_ranks double, ties double"
_SUMMED = ["n", "up", "down", "up_ranks", "down_ranks", "ties"]


def _rank_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merged differences (part, g, m, n, up, down) in order of m as rows of ``RANK_SUMS``."""
    sums: dict = {}  # (group, whole) -> _SUMMED
    zeros: dict = {}
    part, held = 0, None  # held: the rows of the last value, which may go on in the next batch

    def add(rows: pd.DataFrame) -> None:
        for whole in (False, True):
            keys = rows["g"] if not whole else pd.Series([None] * len(rows), index=rows.index, dtype=object)
            for g, own in rows.groupby(keys, dropna=False, sort=False):
                at = (None if g is None or g != g else g, whole)
                total = sums.setdefault(at, np.zeros(len(_SUMMED)))
                m, n = own["m"].to_numpy(), own["n"].to_numpy(np.float64)
                starts = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
                tied = np.add.reduceat(n, starts)
                rank = total[0] + np.cumsum(tied) - tied + (tied + 1) / 2
                rank = np.repeat(rank, np.diff(np.r_[starts, len(m)]))
                up, down = own["up"].to_numpy(np.float64), own["down"].to_numpy(np.float64)
                total += [n.sum(), up.sum(), down.sum(), up @ rank, down @ rank, (tied**3 - tied).sum()]

    for batch in batches:
        if not len(batch):
            continue
        part = int(batch[CHUNK].iloc[0])
        for g, n in batch.loc[batch["m"] == 0, ["g", "n"]].itertuples(index=False):
            for at in ((g, False), (None, True)):
                zeros[at] = zeros.get(at, 0) + int(n)
        rows = batch[batch["m"] != 0]
        if not len(rows):
            continue
        rows = rows if held is None else pd.concat([held, rows])
        last = rows["m"] == rows["m"].iloc[-1]
        held = rows[last]
        if len(rows) > len(held):
            add(rows[~last])
    if held is not None:
        add(held)
    keys = list(dict.fromkeys([*sums, *zeros]))
    if keys:
        out = pd.DataFrame([sums.get(k, np.zeros(len(_SUMMED))) for k in keys], columns=_SUMMED)
        out = out.astype({"n": "int64", "up": "int64", "down": "int64"})
        yield out.assign(**{CHUNK: part, "g": [g for g, _ in keys], "whole": [w for _, w in keys], "zeros": [zeros.get(k, 0) for k in keys]})[
            [c.split()[0] for c in RANK_SUMS.split(", ")]
        ]


def wilcoxon_with_total(df: DataFrame, by: str, a: str, b: str, label: str) -> DataFrame:
    """``wilcoxon_statistics`` per group and over all rows (``label``, with ``_total``).

    Differences of equal size are merged per group and dealt by ranges of their size. Every
    range is ranked by itself, for each group and for all rows in one pass; what the ranges
    before it hold shifts its ranks, so a few sums per range and group give the rank sums.
    """
    d = F.col(a) - F.col(b)
    signs = {"up": F.col("_d") > 0, "down": F.col("_d") < 0}
    diffs = df.select(F.col(by).cast("string").alias("g"), d.alias("_d")).where("_d is not null")
    merged = diffs.groupBy("g", F.abs("_d").cast("double").alias("m")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count(F.when(c, 1)).alias(s) for s, c in signs.items()]
    )
    parts = ranged(merged, ["m"]).sortWithinPartitions("m").withColumn(CHUNK, F.spark_partition_id())
    sums = pin(parts.mapInPandas(_rank_sums, RANK_SUMS)).where("whole or g is not null")
    before = Window.partitionBy("whole", "g").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    shifted = sums.withColumn("_base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    found = shifted.groupBy("whole", "g").agg(
        F.sum("zeros").alias("zeros"),
        F.nullif(F.sum("n"), F.lit(0)).alias("n"),
        *[F.sum(F.col(s) * F.col("_base") + F.col(f"{s}_ranks")).alias(w) for s, w in (("up", "w_plus"), ("down", "w_minus"))],
        F.sum("ties").alias("_ties"),
    )
    known = F.col("n").isNotNull()
    found = found.select(
        F.when(F.col("whole"), F.lit(label)).otherwise(F.col("g")).cast(df.schema[by].dataType).alias(by),
        F.col("whole").alias("_total"), "zeros", "n", *[F.when(known, F.col(c)).alias(c) for c in ("w_plus", "w_minus", "_ties")],
    )
    return _scored(found)


def wilcoxon_by(
    df: DataFrame,
    by: list[str],
    a: str,
    b: str,
    alternative: str = "greater",
    method: str = "auto",
    exact_pairs: int = EXACT_PAIRS,
) -> DataFrame:
    """Wilcoxon signed-rank test; two-sided reports min(W+, W-), one-sided W+. ``w_method`` tells
    which distribution ``w_p`` is from."""
    return _tested(wilcoxon_statistics(df, by, a, b), alternative, method, exact_pairs)


def _tested(stats: DataFrame, alternative: str, method: str, exact_pairs: int) -> DataFrame:
    statistic = (
        F.least("w_plus", "w_minus") if alternative == "two-sided" else F.col("w_plus")
    )
    chosen = wilcoxon_method(F.col("n"), F.col("zeros"), F.col("has_ties"), method, exact_pairs)
    stats = stats.withColumn("w", statistic).withColumn("w_method", chosen)
    return stats.withColumn("w_p", wilcoxon_p(alternative)("w_plus", "n", "z", "w_method"))


def compare_methods(
    df: DataFrame, by: str, a: str, b: str, alternative: str = "greater", label: str = "Overall",
    exact_pairs: int = EXACT_PAIRS,
) -> DataFrame:
    """Means, difference, t, p, d, W, its p and method, per group and over all rows.

    The three columns are computed once. The total's moments are merged from the groups', and
    its ranks come from the order of the groups' ranks. A group that is called like ``label``
    stays one of its own. Rows without a group count in the total only.
    """
    rows = pin(df.select(by, a, b))
    moments = pin(_moments(rows, [by], a, b))
    groups = moments.filter(F.col(by).isNotNull()).withColumn("_total", F.lit(False))
    total = _merged(moments.drop(by)).select(F.lit(label).alias(by), "*", F.lit(True).alias("_total"))
    effects = _effects(groups.unionByName(total))
    effects = effects.withColumn("t_p", t_test_p(alternative)(F.col("t"), F.col("dof").cast("double")))
    tests = _tested(wilcoxon_with_total(rows, by, a, b, label), alternative, "auto", exact_pairs).drop("zeros", "has_ties")
    joined = effects.join(tests.withColumnRenamed("n", "n_pairs"), [by, "_total"], "left")
    return joined.drop("_total")


def significant(comparison: DataFrame, p: str = "t_p", level: float = 0.05) -> DataFrame:
    """Decision rule: p below the level and the first mean above the second."""
    rule = (F.col(p) < level) & (F.col("mean_a") > F.col("mean_b"))
    return comparison.withColumn("significant", rule)
