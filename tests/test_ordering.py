"""Chunked positions, running sums and look-back against plain Python, one group being hot."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from trialbook.operators import ordering


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    table = []
    for i in range(1200):
        group = "hot" if i % 3 else rng.choice(["a", "b", "c", None])
        value = rng.choice([1.0, 2.0, 2.5, 7.0]) if i % 2 else rng.random()
        table.append((i, group, None if i % 17 == 0 else value))
    rng.shuffle(table)
    return table


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, "id long, g string, v double").repartition(5).cache()


def groups(data):
    out = {}
    for i, g, v in sorted(data):
        out.setdefault(g, []).append((i, v))
    return out


def test_positions(df, data):
    got = rows(ordering.positions(df, ["g"], ["id"]), "id", "pos", "pos_total")
    want = [(i, n + 1, len(m)) for m in groups(data).values() for n, (i, _) in enumerate(m)]
    assert got == sorted(want)


def test_positions_of_the_whole_table(df, data):
    got = rows(ordering.positions(df, [], ["id"]), "id", "pos")
    assert got == [(i, i + 1) for i in range(len(data))]


def test_running_total(df, data):
    chunks = ordering.chunk(df, ["g"], ["id"])
    got = rows(ordering.running_total(chunks, ["g"], ["id"], {"s": F.col("id")}), "id", "s")
    want = []
    for members in groups(data).values():
        total = 0
        for i, _ in members:
            total += i
            want.append((i, total))
    assert got == sorted(want)


def test_previous_keeps_nulls_and_crosses_chunks(df, data):
    got = dict(rows(ordering.previous(df, ["g"], ["id"], ["v"]), "id", "prev_v"))
    for members in groups(data).values():
        before = None
        for i, value in members:
            assert got[i] == before
            before = value


def test_ranked_values(df, data):
    got = rows(ordering.ranked_values(df, ["g"], "v"), "g", "v", "n", "below", "total")
    want = []
    for g, members in groups(data).items():
        values = sorted(v for _, v in members if v is not None)
        for v in sorted(set(values)):
            want.append((g, v, values.count(v), sum(x < v for x in values), len(values)))
    key = lambda r: (r[0] is not None, r[0] or "", r[1])
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("q", [0.0, 0.1, 0.25, 0.5, 0.9, 1.0])
def test_percentiles(df, data, q):
    got = dict(rows(ordering.percentiles(df, ["g"], "v", {"p": q}), "g", "p"))
    for g, members in groups(data).items():
        values = sorted(v for _, v in members if v is not None)
        at = q * (len(values) - 1)
        lo = int(at)
        hi = min(lo + 1, len(values) - 1)
        assert got[g] == pytest.approx(values[lo] + (values[hi] - values[lo]) * (at - lo))


def test_hash_positions_do_not_depend_on_partitions(df):
    one = rows(ordering.hash_positions(df, "id"), "id", "pos")
    other = rows(ordering.hash_positions(df.repartition(3, "v"), "id"), "id", "pos")
    assert one == other
    assert sorted(p for _, p in one) == list(range(1, 1201))
    assert one != rows(ordering.hash_positions(df, "id", seed=7), "id", "pos")


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_hash_intervals_match_positions(df, digits):
    cuts = [100, 101, 650]
    got = dict(rows(ordering.hash_intervals(df, "id", lambda n: [F.lit(c) for c in cuts], digits=digits), "id", "interval"))
    for i, pos in rows(ordering.hash_positions(df, "id"), "id", "pos"):
        assert got[i] == sum(pos > c for c in cuts)


def test_top_n(df, data):
    got = rows(ordering.top_n(df, ["g"], [F.col("v").desc_nulls_last(), F.col("id")], 5), "g", "id", "rank")
    want = []
    for g, members in groups(data).items():
        ordered = sorted(members, key=lambda m: (m[1] is None, -(m[1] or 0), m[0]))
        want += [(g, i, n + 1) for n, (i, _) in enumerate(ordered[:5])]
    key = lambda r: (r[0] or "", r[2])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_top_n_is_limited_before_the_shuffle(df):
    plan = ordering.top_n(df, ["g"], [F.col("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
