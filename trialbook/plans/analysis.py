"""Queries of the score analysis: scaling, summaries, distributions, tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialbook.functions import scores as fs
from trialbook.functions.texts import first_integer, map_label
from trialbook.operators import distribution, reshape, scaling, significance, splits, summary
from trialbook.operators.ordering import top_n
from trialbook.plans import views as v
from trialbook.plans.registry import query, stable, stable_sql as r, with_stable
from trialbook.session import pin

TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


# --- score arrays -----------------------------------------------------------------


@query("zscores", f"""
WITH {v.ARRAYS}, u AS (SELECT scenario_id, unnest(s) AS x, unnest(range(len(s))) AS pos, list_aggregate(s, 'avg') AS m,
  list_aggregate(s, 'stddev_pop') AS sd FROM arrays)
SELECT scenario_id, CAST(pos AS INTEGER) AS pos, {r('(x - m) / nullif(sd, 0)')} AS z FROM u""")
def zscores(spark, folder):
    z = v.scored_arrays(spark, folder).select("scenario_id", fs.zscores(F.col("scores")).alias("z"))
    return z.select("scenario_id", F.posexplode("z").alias("pos", "z")).select(
        "scenario_id", "pos", stable("z").alias("z")
    )


@query("coeff_of_var", f"""
WITH {v.ARRAYS}, u AS (SELECT scenario_id, unnest(list_transform(s, lambda x: x + abs(list_min(s)) + 1)) AS x FROM arrays),
c AS (SELECT scenario_id, {r('stddev_pop(x) / avg(x)')} AS cv FROM u GROUP BY 1)
SELECT a.scenario_id, cv AS coeff_of_var FROM arrays a LEFT JOIN c ON c.scenario_id = a.scenario_id""")
def coeff_of_var(spark, folder):
    cv = fs.coeff_of_variation(F.col("scores"))
    return v.scored_arrays(spark, folder).select("scenario_id", stable(cv).alias("coeff_of_var"))


@query("array_mean", f"""
WITH {v.ARRAYS}
SELECT scenario_id, {r("list_aggregate(s, 'avg')")} AS mean_score FROM arrays""")
def array_mean(spark, folder):
    mean = fs.array_mean(F.col("scores"))
    return v.scored_arrays(spark, folder).select("scenario_id", stable(mean).alias("mean_score"))


@query("explode_scores", f"""
WITH {v.ARRAYS}
SELECT scenario_id, CAST(unnest(range(len(ls))) AS INTEGER) AS pos, unnest(ls) AS score FROM arrays""")
def explode_scores(spark, folder):
    return reshape.explode_scores(v.scored_arrays(spark, folder), ["scenario_id"], "llm_scores")


@query("scaled_variance", f"""
WITH {v.ARRAYS}, m AS (
  SELECT dataset, type, avg({r("list_aggregate(ls, 'avg')")}) AS a FROM arrays GROUP BY ALL),
b AS (SELECT type, min(a) AS lo, max(a) AS hi FROM m GROUP BY 1),
rv AS (
  SELECT scenario_id, l.dataset, l.type, CASE WHEN len(ls) > 1 AND hi > lo
    THEN list_aggregate(list_transform(ls, lambda x: (x - lo) / (hi - lo)), 'var_samp') ELSE 0 END AS row_variance
  FROM arrays l JOIN b ON b.type = l.type)
SELECT dataset, type, {r('avg(row_variance)', 5)} AS average_variance FROM rv GROUP BY 1, 2
UNION ALL
SELECT dataset, 'Overall', {r('avg(row_variance)', 5)} FROM rv GROUP BY 1""")
def scaled_variance(spark, folder):
    out = summary.scaled_variance(
        v.scored_arrays(spark, folder), "dataset", "type", "llm_scores", "llm_avg_score"
    )
    return out.select("dataset", "type", stable("average_variance", 5).alias("average_variance"))


@query("run_lengths", f"""
WITH {v.ARRAYS}, n AS (SELECT dataset, type, coalesce(len(ls), 0) AS k FROM arrays)
SELECT dataset, type, {r('avg(k)')} AS average_length, CAST(max(k) AS INTEGER) AS longest,
  {r('coalesce(1.0 / nullif(avg(k), 0), 0)')} AS reciprocal
FROM n GROUP BY 1, 2""")
def run_lengths(spark, folder):
    out = summary.run_lengths(v.scored_arrays(spark, folder), ["dataset", "type"], "llm_scores")
    return with_stable(out, ["average_length", "reciprocal"])


@query("longest_overall", f"WITH {v.ARRAYS} SELECT CAST(coalesce(max(len(ls)), 0) AS INTEGER) AS longest FROM arrays")
def longest_overall(spark, folder):
    return summary.longest_overall(v.scored_arrays(spark, folder), "llm_scores")


# --- row-wise comparison -------------------------------------------------------------


@query("score_diff", f"""
WITH {v.SCORED}
SELECT scenario_id, {r('llm_avg_score - avg_score')} AS score_diff,
  llm_avg_score - avg_score > 0 AS llm_better FROM scored""")
def score_diff(spark, folder):
    out = scaling.score_difference(v.scored(spark, folder), "avg_score", "llm_avg_score")
    return out.select("scenario_id", stable("score_diff").alias("score_diff"), "llm_better")


_FLAGS = f"""
WITH {v.SCORED}, tol AS (SELECT type, avg(abs(avg_score)) / 10.0 AS t FROM scored GROUP BY 1),
flags AS (
  SELECT s.*, llm_avg_score - avg_score > 0 AS llm_better,
    llm_avg_score - avg_score > -t AS llm_correct FROM scored s JOIN tol ON tol.type = s.type)"""


def flagged(spark, folder):
    return scaling.outcome_flags(v.scored(spark, folder), "avg_score", "llm_avg_score", "type")


@query("llm_correct", f"{_FLAGS} SELECT scenario_id, llm_better, llm_correct FROM flags")
def llm_correct(spark, folder):
    return flagged(spark, folder).select("scenario_id", "llm_better", "llm_correct")


@query("outcome_class", f"""{_FLAGS}
SELECT scenario_id, CASE WHEN llm_better THEN 'orange' WHEN llm_correct THEN 'green' ELSE 'blue' END AS color
FROM flags""")
def outcome_class(spark, folder):
    return flagged(spark, folder).select("scenario_id", "color")


@query("outcome_rates", f"""{_FLAGS}
SELECT type, {r('avg(CAST(llm_better AS INT)) * 100')} AS llm_better_ratio,
  {r('avg(CAST(llm_correct AS INT)) * 100')} AS llm_correct_ratio FROM flags GROUP BY 1
UNION ALL SELECT 'Overall', {r('avg(CAST(llm_better AS INT)) * 100')},
  {r('avg(CAST(llm_correct AS INT)) * 100')} FROM flags""")
def outcome_rates(spark, folder):
    rates = summary.outcome_rates(
        flagged(spark, folder), "type",
        {"llm_better_ratio": "llm_better", "llm_correct_ratio": "llm_correct"},
    )
    return with_stable(rates, ["llm_better_ratio", "llm_correct_ratio"])


@query("category_share", f"""{_FLAGS}
SELECT type, {r('sum(CASE WHEN llm_better THEN 1 ELSE 0 END) / count(*)')} AS share FROM flags GROUP BY 1""")
def category_share(spark, folder):
    better = F.coalesce(F.col("llm_better"), F.lit(False)).cast("double")
    scored = scaling.score_difference(v.scored(spark, folder), "avg_score", "llm_avg_score")
    return scored.groupBy("type").agg(stable(F.avg(better)).alias("share"))


# --- scaling ---------------------------------------------------------------------------


@query("rel_scores", f"""
WITH {v.SCORED}
SELECT scenario_id,
  {r('(avg_score - min(avg_score) OVER w) / nullif(max(avg_score) OVER w - min(avg_score) OVER w, 0)')} AS rel_avg_score,
  {r('(llm_avg_score - min(llm_avg_score) OVER w) / nullif(max(llm_avg_score) OVER w - min(llm_avg_score) OVER w, 0)')} AS rel_llm_avg_score
FROM scored WINDOW w AS (PARTITION BY type)""")
def rel_scores(spark, folder):
    out = scaling.minmax_by(v.scored(spark, folder), ["avg_score", "llm_avg_score"], ["type"])
    return out.select(
        "scenario_id",
        stable("rel_avg_score").alias("rel_avg_score"),
        stable("rel_llm_avg_score").alias("rel_llm_avg_score"),
    )


@query("minmax_joinback", f"""
WITH {v.SCORED}, b AS (SELECT type, dataset, min(avg_score) AS lo, max(avg_score) AS hi FROM scored GROUP BY ALL)
SELECT scenario_id, {r('(avg_score - lo) / nullif(hi - lo, 0)')} AS rel_avg_score
FROM scored s JOIN b ON b.type = s.type AND b.dataset = s.dataset""")
def minmax_joinback(spark, folder):
    out = scaling.minmax_by(v.scored(spark, folder), ["avg_score"], ["type", "dataset"])
    return out.select("scenario_id", stable("rel_avg_score").alias("rel_avg_score"))


@query("minmax_pair", f"""
WITH {v.JUDGED}, b AS (
  SELECT type, least(min(scores_bt1), min(scores_bt2)) AS lo, greatest(max(scores_bt1), max(scores_bt2)) AS hi
  FROM judged GROUP BY 1)
SELECT scenario_id, CASE WHEN hi > lo THEN {r('(scores_bt1 - lo) / nullif(hi - lo, 0)')} END AS null_a,
  CASE WHEN hi > lo THEN {r('(scores_bt2 - lo) / nullif(hi - lo, 0)')} END AS null_b,
  CASE WHEN scores_bt2 IS NULL THEN NULL WHEN hi > lo THEN {r('(scores_bt2 - lo) / nullif(hi - lo, 0)')}
    ELSE {r('0')} END AS zero_b
FROM judged j JOIN b ON b.type = j.type""")
def minmax_pair(spark, folder):
    pair = ["scores_bt1", "scores_bt2"]
    base = v.judged(spark, folder).select("scenario_id", "type", *pair)
    modes = {"null_": "null", "zero_": "zero"}
    both = scaling.minmax_by(base, pair, ["type"], shared=True, modes=modes)
    return both.select(
        "scenario_id",
        stable("null_scores_bt1").alias("null_a"),
        stable("null_scores_bt2").alias("null_b"),
        stable("zero_scores_bt2").alias("zero_b"),
    )


# --- grouped summaries -----------------------------------------------------------------


@query("mean_by_type", f"""
WITH {v.SCORED} SELECT type, {r('avg(avg_score)')} AS avg_score, {r('avg(llm_avg_score)')} AS llm_avg_score
FROM scored GROUP BY 1""")
def mean_by_type(spark, folder):
    return v.scored(spark, folder).groupBy("type").agg(
        stable(F.avg("avg_score")).alias("avg_score"), stable(F.avg("llm_avg_score")).alias("llm_avg_score")
    )


@query("mean_rollup", f"""
WITH {v.SCORED}, rel AS (
  SELECT type, (avg_score - min(avg_score) OVER w) / nullif(max(avg_score) OVER w - min(avg_score) OVER w, 0) AS x
  FROM scored WINDOW w AS (PARTITION BY type))
SELECT type, {r('avg(x)')} AS mean_relative FROM rel GROUP BY 1
UNION ALL SELECT 'Overall', {r('avg(x)')} FROM rel""")
def mean_rollup(spark, folder):
    out = summary.relative_means(v.scored(spark, folder), "type", "avg_score")
    return with_stable(out, ["mean_relative"])


@query("mean_rollup_by_dataset", f"""
WITH {v.SCORED}
SELECT dataset, type, {r('avg(llm_avg_score)')} AS llm_avg_score FROM scored GROUP BY 1, 2
UNION ALL SELECT dataset, 'Average', {r('avg(llm_avg_score)')} FROM scored GROUP BY 1""")
def mean_rollup_by_dataset(spark, folder):
    out = summary.mean_with_total(
        v.scored(spark, folder), "type", "llm_avg_score", label="Average", keys=["dataset"]
    )
    return with_stable(out, ["llm_avg_score"])


_SCALED = f"""
WITH {v.SCORED}, m AS (SELECT dataset, type, avg(llm_avg_score) AS a FROM scored GROUP BY ALL),
b AS (SELECT type, min(a) AS lo, max(a) AS hi FROM m GROUP BY 1),
sc AS (SELECT dataset, m.type, a, CASE WHEN hi > lo THEN (a - lo) / (hi - lo) ELSE 0 END AS x
  FROM m JOIN b ON b.type = m.type)"""


@query("scaled_overall", f"""{_SCALED}
SELECT dataset, type, {r('x')} AS scaled_score FROM sc
UNION ALL SELECT dataset, 'Overall', {r('avg(x)')} FROM sc GROUP BY 1""")
def scaled_overall(spark, folder):
    out = summary.scaled_overall(v.scored(spark, folder), "dataset", "type", "llm_avg_score")
    return with_stable(out, ["scaled_score"])


@query("size_curve", f"""
WITH {v.SCORED}
SELECT CAST(regexp_extract(dataset, '[0-9]+') AS BIGINT) AS x_value, type, {r('avg(llm_avg_score)')} AS mean_score
FROM scored GROUP BY 1, 2""")
def size_curve(spark, folder):
    out = reshape.size_curve(v.scored(spark, folder), "dataset", "type", "llm_avg_score")
    return with_stable(out, ["mean_score"])


@query("scaled_by_size", f"""{_SCALED}, c AS (
  SELECT CAST(regexp_extract(dataset, '[0-9]+') AS BIGINT) AS x_value, type, x FROM sc)
SELECT x_value, type, {r('x')} AS scaled_score FROM c
UNION ALL SELECT x_value, 'Average', {r('avg(x)')} FROM c GROUP BY 1""")
def scaled_by_size(spark, folder):
    curve = reshape.size_curve(v.scored(spark, folder), "dataset", "type", "llm_avg_score")
    return with_stable(summary.scaled_by_size(curve, "x_value", "type", "mean_score"), ["scaled_score"])


@query("dataset_size", """
SELECT page_id, CAST(regexp_extract(url, '[0-9]+') AS BIGINT) AS size FROM pages
WHERE regexp_extract(url, '[0-9]+') <> ''""")
def dataset_size(spark, folder):
    sized = v.table(spark, folder, "pages").select("page_id", first_integer(F.col("url")).alias("size"))
    return sized.filter("size is not null")


@query("median_overall", f"""
WITH {v.SCORED}, m AS (SELECT dataset, type, median(llm_avg_score) AS x FROM scored GROUP BY ALL)
SELECT dataset, type, {r('x')} AS median_score FROM m
UNION ALL SELECT dataset, 'Overall', {r('median(x)')} FROM m GROUP BY 1""")
def median_overall(spark, folder):
    out = summary.median_overall(v.scored(spark, folder), "dataset", "type", "llm_avg_score")
    return with_stable(out, ["median_score"])


@query("minmax_by_type", f"""
WITH {v.SCORED} SELECT type, min(avg_score) AS min_score, max(avg_score) AS max_score FROM scored GROUP BY 1""")
def minmax_by_type(spark, folder):
    return v.scored(spark, folder).groupBy("type").agg(
        F.min("avg_score").alias("min_score"), F.max("avg_score").alias("max_score")
    )


@query("summary_by_type_dataset", f"""
WITH {v.SCORED} SELECT type, dataset, min(llm_avg_score) AS min_score, {r('avg(llm_avg_score)')} AS mean_score,
  max(llm_avg_score) AS max_score FROM scored GROUP BY 1, 2""")
def summary_by_type_dataset(spark, folder):
    return v.scored(spark, folder).groupBy("type", "dataset").agg(
        F.min("llm_avg_score").alias("min_score"),
        stable(F.avg("llm_avg_score")).alias("mean_score"),
        F.max("llm_avg_score").alias("max_score"),
    )


@query("multi_stats", f"""
WITH {v.SCORED}, l AS (
  SELECT type, 'avg_score' AS metric, avg_score AS x FROM scored
  UNION ALL SELECT type, 'llm_avg_score', llm_avg_score FROM scored)
SELECT type, metric, min(x) AS min_score, max(x) AS max_score, {r('avg(x)')} AS mean_score,
  {r('median(x)')} AS median_score FROM l GROUP BY 1, 2""")
def multi_stats(spark, folder):
    out = summary.multi_stats(v.scored(spark, folder), ["type"], ["avg_score", "llm_avg_score"])
    return with_stable(out, ["mean_score", "median_score"])


@query("describe_by", f"""
WITH {v.COMPLETE}, l AS (
  SELECT type, 'avg_score' AS score_type, avg_score AS x FROM complete
  UNION ALL SELECT type, 'llm_avg_score', llm_avg_score FROM complete)
SELECT type, score_type, count(x) AS count, {r('avg(x)')} AS mean, {r('stddev_samp(x)', 3)} AS std,
  min(x) AS min, {r('quantile_cont(x, 0.25)')} AS q25, {r('quantile_cont(x, 0.5)')} AS q50,
  {r('quantile_cont(x, 0.75)')} AS q75, max(x) AS max FROM l GROUP BY 1, 2""")
def describe_by(spark, folder):
    long = reshape.melt(v.complete(spark, folder), ["type"], ["avg_score", "llm_avg_score"])
    out = summary.describe_by(long, ["type", "score_type"], "score")
    out = with_stable(out, ["mean", "q25", "q50", "q75"])
    return out.withColumn("std", stable("std", 3))


@query("completeness", f"""
WITH {v.SCORED} SELECT type, count(*) AS n_rows, count(avg_score) AS n_present,
  {r('count(avg_score) / count(*)')} AS ratio FROM scored GROUP BY 1""")
def completeness(spark, folder):
    return with_stable(summary.completeness(v.scored(spark, folder), "type", "avg_score"), ["ratio"])


@query("cleaning_ratio", f"""
WITH {v.JUDGED} SELECT type, count(*) AS n_before, count(scores_bt1 + scores_bt2) AS n_after,
  {r('count(scores_bt1 + scores_bt2) / count(*)')} AS ratio FROM judged GROUP BY 1""")
def cleaning_ratio(spark, folder):
    out = summary.cleaning_ratio(v.judged(spark, folder), "type", ["scores_bt1", "scores_bt2"])
    return with_stable(out, ["ratio"])


@query("null_by_bucket", f"""
WITH {v.SCORED}, n AS (SELECT *, row_number() OVER (ORDER BY scenario_id) - 1 AS i FROM scored)
SELECT i // 100 AS bucket, count(*) AS n_rows, CAST(sum(CASE WHEN avg_score IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing
FROM n GROUP BY 1""")
def null_by_bucket(spark, folder):
    rows = splits.row_ids(v.scored(spark, folder).select("scenario_id", "avg_score"), ["scenario_id"])
    return summary.null_by_bucket(rows, "original_index", "avg_score")


@query("null_fraction", f"""
WITH {v.SCORED}
SELECT type, {r('avg(CASE WHEN llm_avg_score IS NULL THEN 1.0 ELSE 0 END)')} AS nan_fraction FROM scored GROUP BY 1
UNION ALL SELECT 'Overall', {r('avg(CASE WHEN llm_avg_score IS NULL THEN 1.0 ELSE 0 END)')} FROM scored""")
def null_fraction(spark, folder):
    out = summary.missing_fraction(v.scored(spark, folder), "type", "llm_avg_score")
    return with_stable(out, ["nan_fraction"])


@query("distinct_types", f"WITH {v.SCORED} SELECT DISTINCT type FROM scored")
def distinct_types(spark, folder):
    return v.table(spark, folder, "orders").select(F.col("o_orderpriority").alias("type")).distinct()


@query("side_by_side", f"""
WITH {v.COMPLETE}
SELECT 'Min' AS statistic, {r('min(avg_score)')} AS avg_score, {r('min(llm_avg_score)')} AS llm_avg_score FROM complete
UNION ALL SELECT 'Max', {r('max(avg_score)')}, {r('max(llm_avg_score)')} FROM complete
UNION ALL SELECT 'Mean', {r('avg(avg_score)')}, {r('avg(llm_avg_score)')} FROM complete
UNION ALL SELECT 'Median', {r('median(avg_score)')}, {r('median(llm_avg_score)')} FROM complete""")
def side_by_side(spark, folder):
    columns = ["avg_score", "llm_avg_score"]
    return with_stable(summary.side_by_side(v.complete(spark, folder), columns), columns)


# --- epochs of preference data -----------------------------------------------------------


@query("mean_by_epoch_type", f"""
WITH {v.EPOCHS} SELECT dataset_position, type, {r('avg(scores_bt1)')} AS bt1, {r('avg(scores_bt2)')} AS bt2
FROM epochs GROUP BY 1, 2""")
def mean_by_epoch_type(spark, folder):
    return v.epochs(spark, folder).groupBy("dataset_position", "type").agg(
        stable(F.avg("scores_bt1")).alias("bt1"), stable(F.avg("scores_bt2")).alias("bt2")
    )


@query("epoch_counts", f"""
WITH {v.EPOCHS}
SELECT dataset_position, type, count(scores_bt2) AS n FROM epochs GROUP BY 1, 2
UNION ALL SELECT dataset_position, 'Overall', count(scores_bt2) FROM epochs GROUP BY 1""")
def epoch_counts(spark, folder):
    per_type = v.epochs(spark, folder).groupBy("dataset_position", "type").agg(
        F.count("scores_bt2").alias("n")
    )
    total = per_type.groupBy("dataset_position").agg(F.sum("n").alias("n"))
    return per_type.unionByName(total.withColumn("type", F.lit("Overall")))


@query("epoch_mean", f"""
WITH {v.EPOCHS} SELECT scenario_id, dataset_position, {r('(scores_bt1 + scores_bt2) / 2')} AS mean_score FROM epochs""")
def epoch_mean(spark, folder):
    mean = (F.col("scores_bt1") + F.col("scores_bt2")) / 2
    return v.epochs(spark, folder).select(
        "scenario_id", "dataset_position", stable(mean).alias("mean_score")
    )


@query("epoch_rows", f"""
WITH {v.EPOCHS} SELECT scenario_id, type, scores_bt1 FROM epochs WHERE dataset_position = 3""")
def epoch_rows(spark, folder):
    rows = v.epochs(spark, folder).filter(F.col("dataset_position") == 3)
    return rows.select("scenario_id", "type", "scores_bt1")


@query("epoch_union", f"""
WITH {v.EPOCHS} SELECT scenario_id, dataset_position FROM epochs""")
def epoch_union(spark, folder):
    from trialbook.operators.combine import by_position

    rows = v.judged(spark, folder).select("scenario_id")
    return by_position(rows, (F.col("scenario_id") % 5).cast("int"))


# --- ranks and order ---------------------------------------------------------------------


@query("top_n_by_type", f"""
WITH {v.SCORED}, k AS (
  SELECT type, scenario_id, avg_score,
    CAST(row_number() OVER (PARTITION BY type ORDER BY avg_score DESC NULLS LAST, scenario_id) AS INTEGER) AS rank FROM scored)
SELECT * FROM k WHERE rank <= 25""")
def top_n_by_type(spark, folder):
    order = [F.col("avg_score").desc_nulls_last(), F.col("scenario_id")]
    return top_n(v.scored(spark, folder), ["type"], order, 25).select(
        "type", "scenario_id", "avg_score", "rank"
    )


@query("nth_by_type", f"""
WITH {v.SCORED}, k AS (
  SELECT type, scenario_id, row_number() OVER (PARTITION BY type ORDER BY scenario_id) AS i FROM scored)
SELECT type, scenario_id FROM k WHERE i = 11""")
def nth_by_type(spark, folder):
    rows = v.table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("type"), F.col("o_orderkey").alias("scenario_id")
    )
    found = top_n(rows, ["type"], [F.col("scenario_id")], 11).filter("rank = 11")
    return found.select("type", "scenario_id")


@query("ids_by_type", f"""
WITH {v.SCORED}
SELECT type, row_number() OVER (PARTITION BY type ORDER BY scenario_id) AS place, scenario_id FROM scored""")
def ids_by_type(spark, folder):
    from trialbook.operators.ordering import positions

    rows = v.table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("type"), F.col("o_orderkey").alias("scenario_id")
    )
    return positions(rows, ["type"], ["scenario_id"], "place").select("type", "place", "scenario_id")


@query("avg_rank", f"""
WITH {v.JUDGED}
SELECT scenario_id, rank() OVER (PARTITION BY type ORDER BY scores_bt1)
  + (count(*) OVER (PARTITION BY type, scores_bt1) - 1) / 2.0 AS avg_rank FROM judged""")
def avg_rank(spark, folder):
    rows = v.judged(spark, folder).select("scenario_id", "type", "scores_bt1")
    return significance.average_ranks(rows, ["type"], "scores_bt1").select("scenario_id", "avg_rank")


@query("spearman", f"""
WITH {v.COMPLETE}, k AS (
  SELECT rank() OVER (ORDER BY avg_score) + (count(*) OVER (PARTITION BY avg_score) - 1) / 2.0 AS ra,
    rank() OVER (ORDER BY llm_avg_score) + (count(*) OVER (PARTITION BY llm_avg_score) - 1) / 2.0 AS rb
  FROM complete)
SELECT count(*) AS n, {r('corr(ra, rb)')} AS spearman FROM k""")
def spearman(spark, folder):
    out = significance.spearman(v.complete(spark, folder), "avg_score", "llm_avg_score")
    return with_stable(out, ["spearman"])


@query("pearson_by_type", f"""
WITH {v.COMPLETE} SELECT type, {r('corr(avg_score, llm_avg_score)')} AS correlation FROM complete GROUP BY 1""")
def pearson_by_type(spark, folder):
    out = significance.pearson_by(v.complete(spark, folder), ["type"], "avg_score", "llm_avg_score")
    return with_stable(out, ["correlation"])


# --- tests ---------------------------------------------------------------------------------

_EFFECT = """
  SELECT type, count(llm_avg_score) AS n_a, count(avg_score) AS n_b, avg(llm_avg_score) AS mean_a,
    avg(avg_score) AS mean_b,
    sqrt(((count(llm_avg_score) - 1) * var_samp(llm_avg_score) + (count(avg_score) - 1) * var_samp(avg_score))
      / (count(llm_avg_score) + count(avg_score) - 2)) AS sp FROM {source} GROUP BY 1"""
_EFFECT_COLUMNS = f"""type, n_a, n_b, {r('mean_a')} AS mean_a, {r('mean_b')} AS mean_b,
  {r('mean_b - mean_a')} AS mean_difference, {r('sp', 3)} AS pooled_sd,
  {r('(mean_b - mean_a) / nullif(sp, 0)')} AS cohens_d,
  {r('(mean_a - mean_b) / nullif(sp * sqrt(1.0 / n_a + 1.0 / n_b), 0)')} AS t, n_a + n_b - 2 AS dof"""


def _effect_columns(df):
    rounded = with_stable(df, ["mean_a", "mean_b", "mean_difference", "cohens_d", "t"])
    return rounded.withColumn("pooled_sd", stable("pooled_sd", 3)).select(
        "type", "n_a", "n_b", "mean_a", "mean_b", "mean_difference", "pooled_sd", "cohens_d", "t", "dof"
    )


@query("cohens_d", f"""
WITH {v.COMPLETE}, e AS ({_EFFECT.format(source='complete')})
SELECT type, {r('sp', 3)} AS pooled_sd, {r('(mean_b - mean_a) / nullif(sp, 0)')} AS cohens_d FROM e""")
def cohens_d(spark, folder):
    out = significance.effect_size(v.complete(spark, folder), ["type"], "llm_avg_score", "avg_score")
    return out.select(
        "type", stable("pooled_sd", 3).alias("pooled_sd"), stable("cohens_d").alias("cohens_d")
    )


@query("ttest_by_type", f"WITH {v.COMPLETE}, e AS ({_EFFECT.format(source='complete')}) SELECT {_EFFECT_COLUMNS} FROM e")
def ttest_by_type(spark, folder):
    out = significance.t_test_by(v.complete(spark, folder), ["type"], "llm_avg_score", "avg_score")
    return _effect_columns(out)


_WILCOXON = """
  SELECT type, count(*) AS n, sum(CASE WHEN d > 0 THEN k ELSE 0 END) AS w_plus,
    sum(CASE WHEN d < 0 THEN k ELSE 0 END) AS w_minus, sum(t * t - 1) AS ties
  FROM (SELECT type, d, rank() OVER (PARTITION BY type ORDER BY abs(d)) + (count(*) OVER (PARTITION BY type, abs(d)) - 1) / 2.0 AS k,
      CAST(count(*) OVER (PARTITION BY type, abs(d)) AS DOUBLE) AS t
    FROM (SELECT type, {a} - {b} AS d FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) WHERE d <> 0)
  GROUP BY 1"""
_Z = "(w_plus - n * (n + 1) / 4.0) / nullif(sqrt(n * (n + 1) * (2.0 * n + 1) / 24.0 - ties / 48.0), 0)"


@query("wilcoxon_by_type", f"""
WITH {v.JUDGED}, w AS ({_WILCOXON.format(source='judged', a='scores_bt1', b='scores_bt2')}),
z AS (SELECT type, count(CASE WHEN scores_bt1 = scores_bt2 THEN 1 END) AS zeros FROM judged
  WHERE scores_bt2 IS NOT NULL GROUP BY 1)
SELECT z.type, zeros, CAST(n AS BIGINT) AS n, CAST(w_plus AS DOUBLE) AS w_plus, CAST(w_minus AS DOUBLE) AS w_minus, {r(_Z)} AS z
FROM z LEFT JOIN w ON w.type = z.type""")
def wilcoxon_by_type(spark, folder):
    rows = v.judged(spark, folder).select("type", "scores_bt1", "scores_bt2")
    out = significance.wilcoxon_statistics(rows, ["type"], "scores_bt1", "scores_bt2")
    return out.select("type", "zeros", "n", "w_plus", "w_minus", stable("z").alias("z"))


@query("compare_methods", f"""
WITH {v.COMPLETE}, both_ AS (
  SELECT type, llm_avg_score, avg_score FROM complete
  UNION ALL SELECT 'Overall', llm_avg_score, avg_score FROM complete),
e AS ({_EFFECT.format(source='both_')}),
w AS ({_WILCOXON.format(source='both_', a='llm_avg_score', b='avg_score')}),
s AS (SELECT {_EFFECT_COLUMNS} FROM e)
SELECT s.*, CAST(w_plus AS DOUBLE) AS w, {r(_Z)} AS z FROM s JOIN w ON w.type = s.type""")
def compare_methods(spark, folder):
    out = significance.compare_methods(v.complete(spark, folder), "type", "llm_avg_score", "avg_score")
    keep = _effect_columns(out)
    return out.select("type", "w", stable("z").alias("z")).join(keep, "type")


# p < 0.05 one-sided is z above the 95 % point of the normal distribution
@query("significant", f"""
WITH {v.COMPLETE}, both_ AS (
  SELECT type, llm_avg_score, avg_score FROM complete
  UNION ALL SELECT 'Overall', llm_avg_score, avg_score FROM complete),
m AS (SELECT type, avg(llm_avg_score) > avg(avg_score) AS above FROM both_ GROUP BY 1),
w AS ({_WILCOXON.format(source='both_', a='llm_avg_score', b='avg_score')})
SELECT m.type, above AND {_Z} > 1.6448536269514722 AS significant FROM m JOIN w ON w.type = m.type""")
def significant(spark, folder):
    out = significance.compare_methods(v.complete(spark, folder), "type", "llm_avg_score", "avg_score")
    return significance.significant(out, "w_p").select("type", "significant")


# tails by Simpson sums of the densities from 0 on, in 4000 steps
def _tails(source: str) -> str:
    weight = "CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"""t_tail AS (
  SELECT key, 0.5 - sum({weight} * t / 4000 * exp(lgamma((dof + 1) / 2.0) - lgamma(dof / 2.0) - 0.5 * ln(pi() * dof)
    - (dof + 1) / 2.0 * ln(1 + (t * i / 4000) * (t * i / 4000) / dof))) / 3 AS t_up FROM {source}, range(4001) s(i) GROUP BY key),
z_tail AS (
  SELECT key, 0.5 - sum({weight} * z / 4000 * exp(-0.5 * (z * i / 4000) * (z * i / 4000)) / sqrt(2 * pi())) / 3 AS z_up
  FROM {source}, range(4001) s(i) GROUP BY key)"""


@query("p_values", f"""
WITH {v.COMPLETE}, both_ AS (
  SELECT type, llm_avg_score, avg_score FROM complete
  UNION ALL SELECT 'Overall', llm_avg_score, avg_score FROM complete),
e AS ({_EFFECT.format(source='both_')}),
w AS ({_WILCOXON.format(source='both_', a='llm_avg_score', b='avg_score')}),
k AS (SELECT e.type AS key, n_a + n_b - 2 AS dof, (mean_a - mean_b) / (sp * sqrt(1.0 / n_a + 1.0 / n_b)) AS t, {_Z} AS z
  FROM e JOIN w ON w.type = e.type),
{_tails('k')}
SELECT a.key AS type, {r('t_up', 8)} AS t_p, {r('z_up', 8)} AS w_p, {r('1 - t_up', 8)} AS t_less, {r('1 - z_up', 8)} AS w_less,
  {r('2 * least(t_up, 1 - t_up)', 8)} AS t_two, {r('2 * least(z_up, 1 - z_up)', 8)} AS w_two, 'normal' AS w_method
FROM t_tail a JOIN z_tail b ON b.key = a.key""")
def p_values(spark, folder):
    rows = v.complete(spark, folder)
    out = significance.compare_methods(rows, "type", "llm_avg_score", "avg_score")
    p, dof = significance.wilcoxon_p, F.col("dof").cast("double")
    for side, name in (("less", "less"), ("two-sided", "two")):
        out = out.withColumn(f"t_{name}", significance.t_test_p(side)("t", dof))
        out = out.withColumn(f"w_{name}", p(side)("w_plus", "n_pairs", "z", "w_method"))
    return with_stable(out, ["t_p", "w_p", "t_less", "w_less", "t_two", "w_two"], 8).select(
        "type", "t_p", "w_p", "t_less", "w_less", "t_two", "w_two", "w_method"
    )


# groups of neighbouring scenarios, small enough to list every choice of signs
@query("p_values_exact", f"""
WITH {v.COMPLETE}, d AS (
  SELECT scenario_id // 10 AS block, llm_avg_score - avg_score AS d FROM complete WHERE llm_avg_score <> avg_score),
k AS (SELECT block, d, row_number() OVER (PARTITION BY block ORDER BY abs(d)) AS k FROM d),
w AS (SELECT block, count(*) AS n, sum(CASE WHEN d > 0 THEN k ELSE 0 END) AS w_plus,
  count(*) - count(DISTINCT abs(d)) AS ties FROM k GROUP BY 1),
sizes AS (SELECT DISTINCT n FROM w),
sums AS (
  SELECT n, choice, sum(CASE WHEN (choice >> (b - 1)) & 1 = 1 THEN b ELSE 0 END) AS s
  FROM sizes, range(1024) c(choice), range(1, 11) x(b) WHERE choice < (1 << n) AND b <= n GROUP BY 1, 2)
SELECT block, CAST(any_value(w.n) AS BIGINT) AS n, CAST(any_value(w_plus) AS DOUBLE) AS w, 'exact' AS w_method,
  {r('count(CASE WHEN s >= w_plus THEN 1 END) / count(*)', 9)} AS w_p
FROM w JOIN sums ON sums.n = w.n WHERE ties = 0 GROUP BY block""")
def p_values_exact(spark, folder):
    rows = v.complete(spark, folder).withColumn("block", F.expr("scenario_id div 10"))
    out = significance.wilcoxon_by(rows.filter("llm_avg_score <> avg_score"), ["block"], "llm_avg_score", "avg_score")
    return out.filter("not has_ties").select("block", "n", "w", "w_method", stable("w_p", 9).alias("w_p"))


@query("stats_long", f"""
WITH {v.COMPLETE}, e AS ({_EFFECT.format(source='complete')})
SELECT type, 'mean_a' AS statistic, {r('mean_a')} AS value FROM e
UNION ALL SELECT type, 'mean_b', {r('mean_b')} FROM e
UNION ALL SELECT type, 'cohens_d', {r('(mean_b - mean_a) / nullif(sp, 0)')} FROM e
UNION ALL SELECT type, 't', {r('(mean_a - mean_b) / nullif(sp * sqrt(1.0 / n_a + 1.0 / n_b), 0)')} FROM e
UNION ALL SELECT type, 'dof', {r('n_a + n_b - 2')} FROM e""")
def stats_long(spark, folder):
    table = significance.effect_size(v.complete(spark, folder), ["type"], "llm_avg_score", "avg_score")
    out = reshape.stats_long(table, ["type"], ["mean_a", "mean_b", "cohens_d", "t", "dof"])
    return with_stable(out, ["value"])


# --- distributions ----------------------------------------------------------------------------


@query("ecdf", f"""
WITH {v.COMPLETE}
SELECT DISTINCT type, avg_score, {r('cume_dist() OVER (PARTITION BY type ORDER BY avg_score)')} AS proportion FROM complete""")
def ecdf(spark, folder):
    return with_stable(distribution.ecdf(v.complete(spark, folder), ["type"], "avg_score"), ["proportion"])


_GAPPED = "CASE WHEN scenario_id % 11 <> 0 THEN type END"


def gapped(spark, folder):
    """Complete scenarios of which some have lost their type."""
    return v.complete(spark, folder).withColumn("type", F.expr(_GAPPED))


@query("histogram30", f"""
WITH {v.COMPLETE}, g AS (SELECT avg_score, {_GAPPED} AS type FROM complete),
b AS (SELECT type, min(avg_score) AS lo, (max(avg_score) - min(avg_score)) / 30 AS w FROM g GROUP BY 1),
k AS (SELECT c.type, lo, w, least(CAST(floor((avg_score - lo) / nullif(w, 0)) AS BIGINT), 29) AS bin
  FROM g c JOIN b ON b.type = c.type)
SELECT type, bin, {r('lo + bin * w')} AS bin_start, count(*) AS n FROM k GROUP BY type, bin, lo, w""")
def histogram30(spark, folder):
    out = distribution.histogram(gapped(spark, folder), ["type"], "avg_score")
    return with_stable(out, ["bin_start"])


@query("kde_grid", f"""
WITH {v.COMPLETE}, s AS (
  SELECT type, count(*) AS n, stddev_samp(avg_score) * pow(count(*), -0.2) AS h, min(avg_score) AS mn, max(avg_score) AS mx
  FROM complete GROUP BY 1),
g AS (SELECT type, n, h, greatest(mn - 3 * h, 0) AS lo, (mx + 3 * h - greatest(mn - 3 * h, 0)) / 49 AS step FROM s),
p AS (SELECT g.*, CAST(i AS INTEGER) AS i, lo + i * step AS x FROM g, range(50) t(i))
SELECT p.type, p.i, {r('any_value(x)', 4)} AS x,
  {r('sum(exp(-0.5 * ((x - avg_score) / h) * ((x - avg_score) / h))) / (any_value(n) * any_value(h) * sqrt(2 * pi()))', 12)} AS density
FROM p JOIN complete c ON c.type = p.type GROUP BY 1, 2""")
def kde_grid(spark, folder):
    clip = (
        v.table(spark, folder, "orders").select(F.col("o_orderpriority").alias("type")).distinct()
        .select("type", F.lit(0.0).alias("clip_lo"), F.lit(None).cast("double").alias("clip_hi"))
    )
    out = distribution.kernel_density(
        v.complete(spark, folder), ["type"], "avg_score", grid=50, clip=clip
    )
    return out.select("type", "i", stable("x", 4).alias("x"), stable("density", 12).alias("density"))


@query("box_stats", f"""
WITH {v.COMPLETE}, q AS (
  SELECT type, count(*) AS n, quantile_cont(avg_score, 0.25) AS q1, median(avg_score) AS med,
    quantile_cont(avg_score, 0.75) AS q3 FROM complete GROUP BY 1)
SELECT q.type, n, {r('q1')} AS q1, {r('med')} AS median, {r('q3')} AS q3,
  {r('least(q1, min(CASE WHEN avg_score >= q1 - 1.5 * (q3 - q1) THEN avg_score END))')} AS whisker_lo,
  {r('greatest(q3, max(CASE WHEN avg_score <= q3 + 1.5 * (q3 - q1) THEN avg_score END))')} AS whisker_hi,
  {r('med - 1.57 * (q3 - q1) / sqrt(n)')} AS notch_lo, {r('med + 1.57 * (q3 - q1) / sqrt(n)')} AS notch_hi
FROM q JOIN complete c ON c.type = q.type GROUP BY q.type, n, q1, med, q3""")
def box_stats(spark, folder):
    out = distribution.box_stats(v.complete(spark, folder), ["type"], "avg_score")
    return with_stable(out, [c for c in out.columns if c not in ("type", "n")])


# --- reshape ------------------------------------------------------------------------------------


@query("melt_scores", f"""
WITH {v.SCORED}
SELECT scenario_id, type, 'avg_score' AS score_type, avg_score AS score FROM scored
UNION ALL SELECT scenario_id, type, 'llm_avg_score', llm_avg_score FROM scored""")
def melt_scores(spark, folder):
    return reshape.melt(v.scored(spark, folder), ["scenario_id", "type"], ["avg_score", "llm_avg_score"])


@query("to_long", f"""
WITH {v.COMPLETE}
SELECT scenario_id, 'A' AS method, llm_avg_score AS score FROM complete
UNION ALL SELECT scenario_id, 'B', avg_score FROM complete""")
def to_long(spark, folder):
    return reshape.to_long(v.complete(spark, folder), ["scenario_id"], "llm_avg_score", "avg_score")


@query("pivot_summary", f"""
WITH {v.SCORED}
SELECT dataset, {', '.join(
    f'''min(CASE WHEN type = '{t}' THEN llm_avg_score END) AS "{t[0]}_min",
    {r(f"avg(CASE WHEN type = '{t}' THEN llm_avg_score END)")} AS "{t[0]}_mean",
    max(CASE WHEN type = '{t}' THEN llm_avg_score END) AS "{t[0]}_max"''' for t in TYPES)}
FROM scored GROUP BY 1""")
def pivot_summary(spark, folder):
    wide = reshape.pivot_stats(v.scored(spark, folder), "dataset", "type", "llm_avg_score", TYPES)
    wide = wide.withColumnsRenamed({f"{t}_{s}": f"{t[0]}_{s}" for t in TYPES for s in ("min", "mean", "max")})
    return with_stable(wide, [f"{t[0]}_mean" for t in TYPES])


@query("label_map", f"""
WITH {v.SCORED}
SELECT scenario_id, CASE lightstype WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE 'Unknown' END AS label,
  CASE lightstype WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE lightstype END AS kept FROM scored""")
def label_map(spark, folder):
    labels = {"F": "Finished", "O": "Open"}
    status = F.col("o_orderstatus")
    return v.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("scenario_id"),
        map_label(status, labels).alias("label"),
        map_label(status, labels, default=None).alias("kept"),
    )
