"""Tests, effect sizes, splits and preference pairs on known cases."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from trialbook.functions import pvalues as pv
from trialbook.operators import combine, distribution, ordering, preferences, significance, splits, summary
from trialbook.session import clear_pinned, pin

A, B = [5.0, 7, 3, 9, 6, 8], [4.0, 7, 5, 6, 3, 7]


@pytest.fixture(scope="module")
def ab(spark):
    return spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(A, B)], "g string, a double, b double")


def test_effect_size(ab):
    r = significance.effect_size(ab, ["g"], "a", "b").first()
    assert (r["mean_a"], r["mean_b"]) == (pytest.approx(6.333333, abs=1e-6), pytest.approx(5.333333, abs=1e-6))
    assert r["pooled_sd"] == pytest.approx(1.914854, abs=1e-6)
    assert r["cohens_d"] == pytest.approx(-0.522233, abs=1e-6)
    assert r["t"] == pytest.approx(0.904534, abs=1e-6) and r["dof"] == 10


def test_wilcoxon(ab):
    r = significance.wilcoxon_by(ab, ["g"], "a", "b").first()
    assert (r["n"], r["zeros"], r["w_plus"], r["w_minus"], r["has_ties"]) == (5, 1, 12.0, 3.0, True)
    assert r["z"] == pytest.approx(1.224745, abs=1e-6)
    assert r["w_p"] == pytest.approx(0.110336, abs=1e-6)
    two = significance.wilcoxon_by(ab, ["g"], "a", "b", "two-sided").first()
    assert two["w"] == 3.0 and two["w_p"] == pytest.approx(2 * 0.110336, abs=1e-6)


def test_flat_group_has_no_effect(spark):
    df = spark.createDataFrame([("g", 1.0, 1.0)] * 3, "g string, a double, b double")
    r = significance.compare_methods(df, "g", "a", "b").filter("g = 'g'").first()
    assert r["cohens_d"] is None and r["t"] is None and r["w"] is None and r["w_p"] is None


@pytest.mark.parametrize("t, df, p", [
    (0.0, 5, 0.5), (1.812461, 10, 0.05), (2.763769, 10, 0.01), (-1.812461, 10, 0.95), (12.7062, 1, 0.025), (1.96234, 1000, 0.025),
])
def test_t_tail(t, df, p):
    assert pv.t_upper(t, df) == pytest.approx(p, abs=2e-6)


@pytest.mark.parametrize("n", [1, 4, 9])
def test_exact_signed_rank(n):
    sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product([0, 1], repeat=n)]
    for w in {0, 1, n * (n + 1) // 4, n * (n + 1) // 2}:
        assert pv.signed_rank_upper(w, n) == pytest.approx(np.mean([s >= w for s in sums]))


def test_calibration_on_normal_samples(spark):
    rng = np.random.default_rng(42)
    x, y, z = rng.normal(0, 1, 3500), rng.normal(0, 1, 3500), rng.normal(10, 1, 3500)
    df = spark.createDataFrame([("g", float(p), float(q), float(s)) for p, q, s in zip(x, y, z)], "g string, x double, y double, z double")
    for side in ("two-sided", "greater", "less"):
        assert significance.wilcoxon_by(df, ["g"], "x", "y", side).first()["w_p"] > 0.01
    assert significance.wilcoxon_by(df, ["g"], "x", "z", "less").first()["w_p"] < 1e-12
    assert significance.wilcoxon_by(df, ["g"], "x", "z", "greater").first()["w_p"] > 0.999999


def test_total_is_the_count_weighted_mean(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 8.0), ("b", None), (None, 100.0)], "t string, x double")
    assert rows(summary.mean_with_total(df, "t", "x"), "t", "x") == [("Overall", 28.0), ("a", 2.0), ("b", 8.0)]


def test_median_of_medians(spark):
    df = spark.createDataFrame([("d", g, float(x)) for g, xs in {"a": [1, 2, 9], "b": [4, 6], "c": [7]}.items() for x in xs], "d string, t string, x double")
    got = dict(rows(summary.median_overall(df, "d", "t", "x"), "t", "median_score"))
    assert got == {"a": 2.0, "b": 5.0, "c": 7.0, "Overall": 5.0}


def test_density_integrates_to_one(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([("g", rng.gauss(0, 1)) for _ in range(400)], "g string, x double")
    grid = rows(distribution.kernel_density(df, ["g"], "x"), "x", "density")
    step = grid[1][0] - grid[0][0]
    assert len(grid) == 200 and sum(d for _, d in grid) * step == pytest.approx(1, abs=0.01)


def test_histogram_without_group(spark):
    df = spark.createDataFrame([(float(i),) for i in range(61)], "x double")
    got = rows(distribution.histogram(df, [], "x", 30), "bin", "n")
    assert sum(n for _, n in got) == 61 and got[-1] == (29, 3)
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert rows(distribution.histogram(flat, [], "x"), "bin", "n") == [(0, 2)]


def test_ladder_is_nested(spark):
    ladder = splits.size_ladder(spark.range(2250), "id").cache()
    assert [s for _, s in rows(splits.ladder_sizes(ladder), "step", "size")] == list(range(225, 2251, 225))
    assert splits.ladder_step(ladder, 3).count() == 675
    odd = splits.size_ladder(spark.range(97), "id")
    assert [s for _, s in rows(splits.ladder_sizes(odd), "step", "size")] == [97 * k // 10 for k in range(1, 11)]


def test_holdout_and_validation_sizes(spark):
    ids = spark.range(1000)
    held = splits.holdout(ids, "id", 50, 200)
    assert rows(held.groupBy("split").count()) == [("train", 200), ("validation", 50)]
    for share, n in ((0.2, 200), (None, 250), (0.0005, 1)):
        drawn = splits.train_validation(ids, "id", share)
        assert drawn.count() == 1000 and drawn.filter("split = 'validation'").count() == n


def test_splits_do_not_shuffle_the_table(spark):
    plan = splits.train_validation(spark.range(1000).withColumn("wide", F.lit("x")), "id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("hashpartitioning(_hp") <= 3  # two prefix counts, one boundary prefix


def test_scaled_pairs_keep_their_answers(spark):
    df = spark.createDataFrame(
        [(1, "t", "q", "a1", "b1", 1.0, 3.0), (2, "t", "q", "a2", "b2", 2.0, None), (3, "u", "q", "a3", "b3", 5.0, 5.0)],
        "i int, type string, q string, ta string, tb string, sa double, sb double",
    )
    pairs = preferences.scaled_pairs(df, "type", "sa", "sb", "ta", "tb", "q")
    assert rows(pairs, "i", "scores_A", "scores_B", "llmout_A", "llmout_B") == [(1, 0.0, 1.0, "a1", "b1")]


def test_choice(spark):
    df = spark.createDataFrame(
        [(1, "q", "a", "b", 0.4, 0.4), (2, "q", "a", "b", 0.5, 0.1), (3, "q", "a", "b", None, 0.1)],
        "i int, llmin string, llmout_A string, llmout_B string, scores_A double, scores_B double",
    )
    plain = preferences.preference_pairs(df, prompt=lambda user, answer: answer)
    assert rows(plain, "i", "chosen", "rejected", "score_chosen", "score_rejected") == [
        (1, "b", "a", 0.4, 0.4), (2, "a", "b", 0.5, 0.1), (3, "b", "a", 0.1, None),
    ]


def test_tie_makes_the_second_better(spark):
    df = spark.createDataFrame([("q", "a", "b", 1.0, 1.0)], "llmin string, llmout_A string, llmout_B string, scores_bt1 double, scores_bt2 double")
    r = preferences.best_of_two(df).first()
    assert (r["llm_behavior_tree"], r["behavior_tree"], r["scores"]) == ("b", "a", [1.0, 1.0])


def test_paired_experiments_need_equal_keys(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, s double")
    assert combine.paired_experiments(a, a, "k").count() == 2
    assert combine.paired_experiments(a, a.filter("k = 1"), "k").count() == 0
    sets = combine.key_sets(a, spark.createDataFrame([(2, 0.0), (9, 0.0)], "k int, s double"), "k").first()
    assert (sets["only_left"], sets["only_right"], sets["in_both"], sets["equal"]) == (1, 1, 1, False)


def test_zip_stops_at_the_shorter(spark):
    a, b = spark.range(10).toDF("a"), spark.range(100, 104).toDF("b")
    assert rows(combine.zip_rows(a, b, ["a"], ["b"]), "a", "b") == [(i, 100 + i) for i in range(4)]


def test_splits_leave_out_incomplete_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (None, 2.0), (3, 3.0), (4, None), (5, 5.0), (6, 6.0)], "k int, x double")
    got = rows(splits.train_validation(df, "k", 0.25), "k", "split")
    assert [k for k, _ in got] == [1, 3, 5, 6] and [s for _, s in got].count("validation") == 1
    assert len(rows(splits.size_ladder(df, "k", 2), "k", "rung")) == 4


def test_rows_without_a_group_are_in_no_bin(spark):
    df = spark.createDataFrame([(None, 5.0), (None, 9.0), ("a", 1.0), ("a", 2.0), ("a", None)], "g string, x double")
    assert rows(distribution.histogram(df, ["g"], "x", 2), "g", "bin", "n") == [("a", 0, 1), ("a", 1, 1)]


def test_whiskers_do_not_end_inside_the_box(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 100.0)], "g string, x double")
    box = distribution.box_stats(df, ["g"], "x").first()
    assert box["whisker_hi"] == box["q3"] == 27.25


@pytest.mark.parametrize("n", [25, 1500])
def test_top_n_of_any_size(spark, n):
    df = spark.range(5000).selectExpr("CAST(id % 2 AS STRING) AS g", "CAST(5000 - id AS DOUBLE) AS x", "'t' AS t")
    got = ordering.top_n(df, ["g"], [F.col("x").desc()], n)
    assert got.columns == ["g", "x", "t", "rank"]
    found = rows(got, "g", "rank", "x")
    assert len(found) == 2 * n and found[:2] == [("0", 1, 5000.0), ("0", 2, 4998.0)]


def test_wilcoxon_tells_its_method(spark):
    few = spark.createDataFrame([("a", float(i), 0.0) for i in range(1, 11)], "g string, a double, b double")
    many = spark.range(1, 61).selectExpr("'b' AS g", "CAST(id AS DOUBLE) AS a", "0.0D AS b")
    got = {r["g"]: (r["w_method"], r["w_p"]) for r in significance.wilcoxon_by(few.unionByName(many), ["g"], "a", "b").collect()}
    assert got["a"] == ("exact", pytest.approx(2**-10)) and got["b"][0] == "normal"
    assert significance.wilcoxon_by(few, ["g"], "a", "b", exact_pairs=5).first()["w_method"] == "normal"
    tied = spark.createDataFrame([("a", 1.0, 0.0), ("a", 1.0, 0.0)], "g string, a double, b double")
    with pytest.raises(Exception, match="no ties"):
        significance.wilcoxon_by(tied, ["g"], "a", "b", method="exact").collect()


def test_a_group_called_like_the_total_stays_its_own(spark):
    df = spark.createDataFrame([("Overall", 1.0, 2.0), ("Overall", 2.0, 4.5), ("b", 5.0, 1.0), ("b", 4.0, 3.5), (None, 9.0, 1.0)], "g string, a double, b double")
    got = sorted((r["g"], r["n_a"], r["n_pairs"]) for r in significance.compare_methods(df, "g", "a", "b").collect())
    assert got == [("Overall", 2, 2), ("Overall", 5, 5), ("b", 2, 2)]


def test_groups_and_total_from_one_order(spark):
    """Rank sums against plain ranks: ties within and between groups, zeros, batches of few rows."""
    rng = random.Random(3)
    data = [(rng.choice(["a", "a", "b", "c", None]), float(rng.randint(0, 40)), float(rng.randint(0, 40))) for _ in range(3000)]
    data += [("flat", 1.0, 1.0), ("gap", None, 1.0), ("gap", 2.0, None)]
    df = spark.createDataFrame(data, "g string, a double, b double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = significance.wilcoxon_with_total(df, "g", "a", "b", "all").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r["g"] for r in found) == ["a", "all", "b", "c", "flat"]
    for r in found:
        d = [x - y for g, x, y in data if x is not None and y is not None and (r["_total"] or g == r["g"])]
        size = np.sort([abs(x) for x in d if x])
        rank = lambda x: (np.searchsorted(size, abs(x)) + 1 + np.searchsorted(size, abs(x), "right")) / 2
        assert r["zeros"] == d.count(0)
        assert (r["n"] or 0) == len(size)
        assert (r["w_plus"] or 0) == sum(rank(x) for x in d if x > 0) and (r["w_minus"] or 0) == sum(rank(x) for x in d if x < 0)
        assert not len(size) or r["has_ties"]
    plain = {r["g"]: r for r in significance.wilcoxon_statistics(df.na.drop(subset=["g"]), ["g"], "a", "b").collect()}
    assert all(r["z"] == pytest.approx(plain[r["g"]]["z"]) for r in found if not r["_total"] and r["z"] is not None)


def test_density_by_moments_is_that_of_all_values(spark):
    rng = random.Random(5)
    data = {"g": [rng.gauss(0, 1) for _ in range(300)] + [40.0], "h": [float(rng.randint(0, 3)) for _ in range(50)], "flat": [1.0, 1.0]}
    df = spark.createDataFrame([(g, x) for g, xs in data.items() for x in [*xs, None]], "g string, x double")
    found = distribution.kernel_density(df, ["g"], "x", grid=80)
    got = {g: [(x, d) for _, x, d in rows(found.where(F.col("g") == g), "i", "x", "density")] for g in data}
    assert got["flat"] == []
    for g in "gh":
        xs = np.array(data[g])
        h = xs.std(ddof=1) * len(xs) ** -0.2
        at = np.array([x for x, _ in got[g]])
        want = np.exp(-0.5 * ((at[:, None] - xs) / h) ** 2).sum(1) / (len(xs) * h * np.sqrt(2 * np.pi))
        assert len(at) == 80 and np.abs(want - [d for _, d in got[g]]).max() < 1e-14


def test_chunks_follow_the_size(spark, monkeypatch):
    monkeypatch.setattr(ordering, "CHUNK_BYTES", 1000)
    df = spark.range(10_000)
    assert ordering._chunk_count(df) == 80
    monkeypatch.setattr(ordering, "CHUNK_BYTES", 1 << 40)
    assert ordering._chunk_count(df) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_pinned_tables_can_be_cleared(spark):
    table = pin(spark.range(3))
    folder = table.inputFiles()[0].removeprefix("file://").removeprefix("file:").rsplit("/", 1)[0]
    assert os.path.exists(folder)
    assert clear_pinned(spark) >= 1 and not os.path.exists(folder)
