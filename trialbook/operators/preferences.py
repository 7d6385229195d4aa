"""Training text and preference pairs from scored answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialbook.functions.scores import coeff_of_variation, zscores
from trialbook.functions.texts import short_prompt
from trialbook.operators.scaling import minmax_by
from trialbook.operators.splits import row_ids


def training_text(
    df: DataFrame, user: str, answer: str, prompt=short_prompt, out: str = "text"
) -> DataFrame:
    """Training text per row; any function (user, answer) -> Column serves as the prompt."""
    return df.withColumn(out, prompt(F.col(user), F.col(answer)))


def preference_pairs(
    df: DataFrame,
    user: str = "llmin",
    out_a: str = "llmout_A",
    out_b: str = "llmout_B",
    score_a: str = "scores_A",
    score_b: str = "scores_B",
    prompt=short_prompt,
) -> DataFrame:
    """Chosen and rejected text with their scores; A wins only with the higher score."""
    a_wins = F.coalesce(F.col(score_a) > F.col(score_b), F.lit(False))

    def pick(first: str, second: str) -> Column:
        return F.when(a_wins, F.col(first)).otherwise(F.col(second))

    return df.select(
        *[c for c in df.columns if c not in (user, out_a, out_b, score_a, score_b)],
        prompt(F.col(user), pick(out_a, out_b)).alias("chosen"),
        prompt(F.col(user), pick(out_b, out_a)).alias("rejected"),
        pick(score_a, score_b).alias("score_chosen"),
        pick(score_b, score_a).alias("score_rejected"),
    )


def best_of_two(df: DataFrame) -> DataFrame:
    """The better answer as the model's, the other as the base; a tie makes the second better."""
    first = F.coalesce(F.col("scores_bt1") > F.col("scores_bt2"), F.lit(False))

    def pick(a: str, b: str) -> Column:
        return F.when(first, F.col(a)).otherwise(F.col(b))

    return (
        df.withColumn("avg_score", pick("scores_bt2", "scores_bt1"))
        .withColumn("behavior_tree", pick("llmout_B", "llmout_A"))
        .withColumn("llm_avg_score", pick("scores_bt1", "scores_bt2"))
        .withColumn("llm_behavior_tree", pick("llmout_A", "llmout_B"))
        .withColumn("description", F.col("llmin"))
        .withColumn("scores", F.array("scores_bt1", "scores_bt2"))
    )


def scaled_pairs(
    df: DataFrame, by: str, a: str, b: str, answer_a: str, answer_b: str, user: str
) -> DataFrame:
    """Score pairs scaled over both columns per group, incomplete ones dropped, in pair layout.

    Each scaled score stays with its own answer.
    """
    scaled = minmax_by(df, [a, b], [by], shared=True, prefix="_scaled_")
    renamed = scaled.withColumnsRenamed(
        {
            f"_scaled_{a}": "scores_A",
            f"_scaled_{b}": "scores_B",
            answer_a: "llmout_A",
            answer_b: "llmout_B",
            user: "llmin",
        }
    )
    return renamed.na.drop("any", subset=["scores_A", "scores_B"])


def sft_table(
    df: DataFrame, key: str, scores: str, user: str, answer: str, required: list[str] | None = None
) -> DataFrame:
    """Row ids, complete rows, z-scores, coefficient of variation, input and output columns."""
    numbered = row_ids(df, [key])
    kept = numbered.na.drop("any", subset=required)
    return (
        kept.withColumn("z_scores", zscores(F.col(scores)))
        .withColumn("coeff_of_var", coeff_of_variation(F.col(scores)))
        .withColumn("llmin", F.col(user))
        .withColumn("llmout", F.col(answer))
    )
