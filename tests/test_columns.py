"""Scalar functions on small golden cases."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from trialbook.functions import controllers as ctl
from trialbook.functions import scores as fs
from trialbook.functions import texts as ft
from trialbook.operators import scaling, scenario, splits


def one(spark, column, **values):
    """Evaluate a column over a one-row table of literals."""
    df = spark.range(1).select(*[v.alias(k) if not isinstance(v, str) else F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("r")).first()["r"]


def doubles(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_zscores(spark):
    got = one(spark, fs.zscores(F.col("a")), a=doubles(0.2, 0.5, 0.8, 0.5))
    assert got == pytest.approx([-1.414214, 0, 1.414214, 0], abs=1e-6)
    assert one(spark, fs.zscores(F.col("a")), a=doubles(3, 3)) == [None, None]
    assert one(spark, fs.zscores(F.col("a")), a=F.lit(None).cast("array<double>")) is None


def test_coefficient_of_variation(spark):
    assert one(spark, fs.coeff_of_variation(F.col("a")), a=doubles(0.2, 0.5, 0.8, 0.5)) == pytest.approx(0.124784, abs=1e-6)
    assert one(spark, fs.coeff_of_variation(F.col("a")), a=doubles(-3, -1, -2)) == pytest.approx(0.408248, abs=1e-6)


def test_array_mean_of_nothing(spark):
    assert one(spark, fs.array_mean(F.col("a")), a=F.array().cast("array<double>")) is None


@pytest.mark.parametrize("mode, flat", [("null", None), ("zero", 0.0)])
def test_degenerate_range(spark, mode, flat):
    low, high = F.lit(2.0), F.lit(2.0)
    assert one(spark, fs.min_max(F.col("x"), low, high, mode), x=F.lit(2.0)) == flat
    assert one(spark, fs.min_max(F.col("x"), low, high, mode), x=F.lit(None).cast("double")) is None
    assert one(spark, fs.min_max(F.col("x"), F.lit(1.0), F.lit(3.0), mode), x=F.lit(2.0)) == 0.5


def test_clip(spark):
    assert one(spark, fs.clip(F.col("x"), 0.0, 1.0), x=F.lit(3.0)) == 1.0
    assert one(spark, fs.clip(F.col("x"), 0.0, None), x=F.lit(-3.0)) == 0.0
    assert one(spark, fs.clip(F.col("x"), 0.0, 1.0), x=F.lit(None).cast("double")) is None


def test_first_integer(spark):
    assert one(spark, ft.first_integer(F.col("x")), x="evaluated_1575.parquet") == 1575
    assert one(spark, ft.first_integer(F.col("x")), x="df_validate") is None


def test_label_map(spark):
    labels = {"a": "A"}
    assert one(spark, ft.map_label(F.col("x"), labels), x="b") == "Unknown"
    assert one(spark, ft.map_label(F.col("x"), labels, None), x="b") == "b"
    assert one(spark, ft.map_label(F.col("x"), labels), x="a") == "A"


@pytest.mark.parametrize("text, want, whole", [
    ("<s>[INST] q [/INST] --nroot 3</s>", " --nroot 3", " --nroot 3"),
    ("no marker", None, "no marker"),
    ("a[/INST]b[/INST]c", "b", "b"),
    ("a[/INST]", "", ""),
])
def test_response(spark, text, want, whole):
    assert one(spark, ft.extract_response(F.col("x")), x=text) == want
    assert one(spark, ft.extract_response(F.col("x"), fallback=True), x=text) == whole


def test_open_prompt_leaves_the_answer_open(spark):
    got = one(spark, ft.open_prompt(F.col("x"), ft.raw_prompt), x="task")
    assert got == "[INST] task [/INST]"


def test_prompts_end_with_the_answer(spark):
    for prompt in (ft.short_prompt, ft.long_prompt, ft.raw_prompt):
        text = one(spark, prompt(F.col("x"), F.lit("--nroot 3")), x="task")
        assert text.startswith("<s>[INST] task") and text.endswith(" [/INST] --nroot 3</s>")


@pytest.mark.parametrize("text, want", [
    ("<v>a</v>", "<v>aNEW</v>"),
    ("</v><v>a</v></v>", "</v><v>aNEW</v></v>"),
    ("<v>a", "<v>a"),
    ("a</v>", "a</v>"),
])
def test_insert_before(spark, text, want):
    assert one(spark, ft.insert_before(F.col("x"), "<v>", "</v>", "NEW"), x=text) == want


def test_uncomment_touches_only_the_block(spark):
    text = "<!-- a -->\n <!-- <qt-opengl>\n<!-- b --> <!-- c -->\n </qt-opengl>-->\n<!-- d -->"
    want = "<!-- a -->\n  <qt-opengl>\n b  <!-- c -->\n </qt-opengl>\n<!-- d -->"
    assert one(spark, ft.uncomment_block(F.col("x")), x=text) == want


@pytest.mark.parametrize("text, n, want", [
    ("1.66,1.65,2.19", 3, [1.66, 1.65, 2.19]),
    (" -1 , 2e-1,.5", 3, [-1.0, 0.2, 0.5]),
    ("1,2", 3, None),
    ("1;2;3", 3, None),
    ("0.75,1.03", 2, [0.75, 1.03]),
    ("1,x", 2, None),
])
def test_vector(spark, text, n, want):
    assert one(spark, ft.vector(F.col("x"), n), x=text) == want


def test_truncate_floats(spark):
    assert one(spark, ft.truncate_floats(F.col("x")), x="at 1.23456 and 12.5, 7.891") == "at 1.23 and 12.5, 7.89"


def test_template(spark):
    filled = ft.fill_template("a{x}b{y}", {"{x}": F.col("x"), "{y}": F.lit(None).cast("string")})
    assert one(spark, filled, x="1") == "a1b"


def test_batch_plan(spark):
    row = scenario.batch_plan(spark.createDataFrame([(25,)], "i long"), "i", 600).first()
    assert (row["per_batch"], row["batch"], row["budget_seconds"], row["budget"]) == (12, 2, 108300, "30:05:00")


def test_target_color(spark):
    schema = "o struct<agg_target:int,ground_area_1:struct<color:string>,ground_area_2:struct<color:string>>"
    data = [((1, ("BLACK",), ("WHITE",)),), ((2, ("BLACK",), ("WHITE",)),), ((1, ("RED",), ("BLACK",)),)]
    df = spark.createDataFrame(data, schema)
    got = [r[0] for r in df.select(scenario.target_color_of(F.col("o"))).collect()]
    assert got == ["black", "white", "white"]


def test_pick_one(spark):
    df = spark.range(300).select("id", splits.pick_one(F.array(F.lit("a"), F.lit("b")), F.col("id")).alias("p"))
    counts = dict(rows(df.groupBy("p").count()))
    assert set(counts) == {"a", "b"} and min(counts.values()) > 100
    assert one(spark, splits.pick_one(F.array().cast("array<string>"), F.lit(1))) is None


def test_drop_infinite_keeps_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("inf")), (3, None), (4, float("-inf"))], "i int, x double")
    assert rows(scaling.drop_infinite(df), "i") == [(1,), (3,)]


TREE = (
    "--nroot 3 --nchildroot 3 --n0 0 --nchild0 2 --n00 6 --c00 1 --p00 0.25 --n01 5 --a01 0 --rwm01 41 --p01 0 "
    "--n1 0 --nchild1 2 --n10 6 --c10 5 --p10 0.75 --n11 5 --a11 5 --rep11 1.5 --p11 0 "
    "--n2 0 --nchild2 2 --n20 6 --c20 4 --p20 7 --w20 12.5 --n21 5 --a21 4 --att21 4.5 --p21 0"
)


def problems(spark, tree):
    df = spark.createDataFrame([(1, tree)], "k int, t string")
    return {(r["flag"], r["problem"]) for r in ctl.grammar_violations(df, "k", "t", ctl.default_grammar()).collect()}


def test_grammar_accepts_the_example(spark):
    assert problems(spark, TREE) == set()
    assert problems(spark, " " + TREE + " ") == set()


@pytest.mark.parametrize("change, want", [
    (("--rwm01 41", "--rwm01 0"), {("rwm01", "out of range")}),
    (("--rwm01 41", "--rwm01 2.5"), {("rwm01", "out of range")}),
    (("--rwm01 41 ", ""), {("rwm01", "missing")}),
    (("--w20 12.5", "--w20 20.5"), {("w20", "out of range")}),
    (("--p20 7", "--p20 0.5"), {("p20", "out of range")}),
    (("--p00 0.25", "--p00 1.5"), {("p00", "out of range")}),
    (("--n00 6", "--n00 7"), {("n00", "out of range")}),
    (("--a01 0", "--a01 1"), {("rwm01", "not applicable")}),
    (("--rwm01 41", "rwm01 95"), {("rwm01", "missing"), (None, "malformed")}),
    (("--nroot 3", "--nroot 3 --nroot 3"), {("nroot", "repeated")}),
    (("--nroot 3", "--nroot 3 --zz 1"), {("zz", "unknown")}),
    (("--p00 0.25", "--p00 x"), {("p00", "out of range")}),
])
def test_grammar_names_the_problem(spark, change, want):
    assert problems(spark, TREE.replace(*change)) == want


def test_grammar_on_missing_branch(spark):
    found = problems(spark, TREE.replace("--nchildroot 3", "--nchildroot 4"))
    assert found == {("n3", "missing")}
    short = problems(spark, TREE.replace("--nchildroot 3", "--nchildroot 2"))
    assert ("n2", "not applicable") in short


def test_no_controller(spark):
    assert {p for _, p in problems(spark, "")} == {"missing"}
    assert {p for _, p in problems(spark, None)} == {"missing"}


def test_tokens_and_nodes(spark):
    df = spark.createDataFrame([(1, TREE)], "k int, t string")
    flags = rows(ctl.tokens(df, "t"), "pos", "flag", "value")
    assert len(flags) == 30 and flags[0] == (0, "nroot", 3.0)
    nodes = rows(ctl.nodes(df, "k", "t"), "branch", "role", "code", "p", "w", "rwm", "att")
    assert len(nodes) == 6
    assert (2, "condition", 4, 7.0, 12.5, None, None) in nodes
    assert (0, "action", 0, 0.0, None, 41.0, None) in nodes


def test_controllers_of_one_split_are_checked_by_many_tasks(spark):
    df = spark.range(0, 400, 1, 1).selectExpr("id AS k", "'--nroot 3 --nchildroot 1 --zz ' || id AS t")
    for grammar in (ctl.default_grammar(), ctl.tree_grammar()):
        found = ctl.grammar_problems(df, "t", grammar)
        of = found.select("k", F.spark_partition_id().alias("task")).groupBy("task").count().collect()
        assert len(of) >= 8 and max(r["count"] for r in of) <= 100
        assert sorted(r["k"] for r in found.where("exists(problems, p -> p.flag = 'zz')").collect()) == list(range(400))


def test_controllers_of_one_split_are_taken_apart_by_many_tasks(spark):
    df = spark.range(0, 400, 1, 1).selectExpr("id AS k", "'--n0 0 --n00 6 --c00 ' || id AS t")
    for found in (ctl.nodes(df, "k", "t"), ctl.tokens(df, "t").where("flag = 'c00'")):
        of = found.select("k", F.spark_partition_id().alias("task")).groupBy("task").count().collect()
        assert len(of) >= 8 and max(r["count"] for r in of) <= 100 and sum(r["count"] for r in of) == 400
