"""Text quality as a sparse ensemble of rules.

Small trees are boosted on a bounded sample of labelled rows; every path from a root to a
node is a rule, a conjunction of comparisons of text statistics. A logistic model with an L1
penalty keeps few of the rules, and these become one Spark column expression: statistics,
rules and score are plain expressions over the text, so scoring is a single pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled rows are fitted on: those with the smallest hash of their id.
SAMPLE = 20_000
FOLDS = 5
TREES, DEPTH, RATE, CUTS, LEAF = 24, 3, 0.3, 24, 20
PENALTY = 0.002
THRESHOLD = 0.3

Rule = tuple[tuple[str, bool, float], ...]  # (statistic, above?, threshold)


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text that needs no other table; all are 0 for an empty text.

    ``_words`` and ``_lines`` must be columns with the text's words and lines.
    """
    words, lines = F.col("_words"), F.col("_lines")
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    repeats = F.aggregate(
        words, F.struct(F.lit("").alias("last"), F.lit(0).alias("n")),
        lambda s, w: F.struct(w.alias("last"), (s["n"] + (s["last"] == w).cast("int")).alias("n")),
    )["n"]
    return {
        "words": F.size(words).cast("double"),
        "chars_per_word": F.length(text) / n,
        "distinct_words": F.size(F.array_distinct(words)) / n,
        "repeats": repeats / n,
        "symbols": F.regexp_count(text, F.lit(r"[#$%&*|<>{}=~^\\/_+]")) / n,
        "shouts": F.regexp_count(text, F.lit(r"[!?]")) / n,
        "capitals": F.regexp_count(text, F.lit(r"\p{Lu}")) / chars,
        "digits": F.regexp_count(text, F.lit(r"[0-9]")) / chars,
        "stops": F.regexp_count(text, F.lit(r"[.,;:]")) / n,
        "words_per_line": n / F.size(lines),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
    }


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` less ``text``, with a struct ``stats``; null text counts as empty."""
    rest = [c for c in docs.columns if c not in (text, "stats", "_text", "_words", "_lines")]
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], value.alias("_text"))
    # split on single white space; empty parts are not words
    words = F.array_remove(F.split("_text", r"\s"), "")
    rows = rows.select("*", words.alias("_words"), F.split("_text", "\n").alias("_lines"))
    stats = F.struct(*[c.cast("double").alias(k) for k, c in statistics(F.col("_text")).items()])
    return rows.select(*[F.col(f"`{c}`") for c in rest], stats.alias("stats"))


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, stats: str = "stats") -> Column:
        """The probability of label 1 as a column expression over the struct of statistics."""

        def holds(rule: Rule) -> Column:
            tests = [F.col(stats)[k] > t if above else F.col(stats)[k] <= t for k, above, t in rule]
            return reduce(Column.__and__, tests)

        parts = [F.when(holds(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules]
        return 1 / (1 + F.exp(-reduce(Column.__add__, parts, F.lit(self.bias))))


def _tree(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, cuts: list[np.ndarray]) -> tuple[list, np.ndarray]:
    """Paths to all nodes of a tree fitted by second-order gain, and the step for each row."""
    paths, step = [], np.zeros(len(x))
    queue = [((), np.arange(len(x)))]
    while queue:
        path, rows = queue.pop()
        g, h = gradient[rows], hessian[rows]
        best = (1e-6, None)
        if len(path) < DEPTH and len(rows) >= 2 * LEAF:
            base = g.sum() ** 2 / (h.sum() + 1)
            for f in range(x.shape[1]):
                place = np.searchsorted(cuts[f], x[rows, f], side="left")
                size = len(cuts[f]) + 1
                left_g, left_h = (np.cumsum(np.bincount(place, v, size))[:-1] for v in (g, h))
                left_n = np.cumsum(np.bincount(place, minlength=size))[:-1]
                gain = left_g**2 / (left_h + 1) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1) - base
                gain[(left_n < LEAF) | (len(rows) - left_n < LEAF)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (f, float(cuts[f][gain.argmax()])))
        if path:
            paths.append(path)
        if best[1] is None:
            step[rows] = -g.sum() / (h.sum() + 1)
            continue
        f, cut = best[1]
        above = x[rows, f] > cut
        queue += [((*path, (f, False, cut)), rows[~above]), ((*path, (f, True, cut)), rows[above])]
    return paths, step


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty, by accelerated proximal steps; the bias is free."""
    z = np.hstack([z, np.ones((len(z), 1))])
    size = np.linalg.norm(z, 2) ** 2 / (4 * len(z))
    w = v = np.zeros(z.shape[1])
    momentum = 1.0
    for _ in range(rounds):
        slope = z.T @ (1 / (1 + np.exp(-np.clip(z @ v, -50, 50))) - y) / len(z)
        new = v - slope / size
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - penalty / size, 0)
        following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        v, w, momentum = new + (momentum - 1) / following * (new - w), new, following
    return float(w[-1]), w[:-1]


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleModel:
    """Rules and weights of a bounded sample: statistics ``x`` (rows, names), labels ``y``.

    Without rows the score is 1, with one label only it is that label's share, smoothed.
    """
    if not len(y):
        return RuleModel(50.0, ())
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return RuleModel(bias, ())
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, CUTS) / CUTS)) for f in range(x.shape[1])]
    seen: dict[tuple, np.ndarray] = {}
    margin = np.full(len(y), bias)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        paths, step = _tree(x, p - y, p * (1 - p), cuts)
        margin += RATE * step
        for path in paths:
            seen.setdefault(tuple(sorted(path)), None)
    kept, columns = [], []
    for path in seen:
        held = np.ones(len(x), bool)
        for f, above, cut in path:
            held &= (x[:, f] > cut) == above
        if 0 < held.sum() < len(held):
            kept.append(path)
            columns.append(held)
    if not kept:
        return RuleModel(bias, ())
    free, weights = _lasso(np.stack(columns, 1).astype(np.float64), y.astype(np.float64), PENALTY)
    rules = tuple(
        (tuple((names[f], above, cut) for f, above, cut in path), float(w)) for path, w in zip(kept, weights) if w
    )
    return RuleModel(free, rules)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    """A model of ``labels.quality`` from rows outside the held-out fold, at most ``sample``
    labels: those whose id hashes lowest. Null ids and null labels are left out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = usable.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # ``sample`` rows at most
    # an id may stand in several documents; the bound holds for the joined rows as well
    rows = with_statistics(rows).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("stats")).limit(sample)
    names = rows.schema["stats"].dataType.names
    found = rows.select("quality", "stats.*").toPandas()
    return fit_rules(found[names].to_numpy(float), found["quality"].to_numpy(int), names)


def score_quality(docs: DataFrame, model: RuleModel, keep: bool = False) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 if the score is at least 0.3).

    Null and empty texts are scored by statistics of 0. Repeated rows stay repeated; an empty
    table gives no rows. ``keep``: a struct column ``doc_row`` holds the row's own columns.
    """
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_row")] if keep else []
    rows = with_statistics(docs.select("doc_id", "text", *own))
    scored = rows.select(*([F.col("doc_row")] if keep else []), "doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, columns as they are, that the classifier does not reject."""
    scored = score_quality(docs, fit_quality(docs, labels), keep=True)
    return scored.where("predicted = 1").select("doc_row.*")
