"""P-values, as vectorised functions over one row per group.

Spark has neither the normal nor the t distribution; the statistics themselves are
plain aggregates elsewhere, only these last steps run in Python.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def regularised_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def t_upper(t: float, df: float) -> float:
    """P(T >= t) for Student's t."""
    tail = 0.5 * regularised_beta(df / 2.0, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1.0 - tail


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def signed_rank_upper(w: float, n: int) -> float:
    """P(W+ >= w) over all sign choices of the ranks 1..n, without ties.

    The distribution is symmetric, so only sums below the nearer tail's end are counted, and
    shares instead of counts keep the numbers in range.
    """
    most = n * (n + 1) // 2
    least = int(math.ceil(w))
    below = least <= most - least + 1  # P(W < w) has fewer sums than P(W >= w)
    top = least - 1 if below else most - least
    if top < 0:
        return 1.0 if below else 0.0
    share = np.zeros(top + 1)
    share[0] = 1.0
    for rank in range(1, n + 1):
        if rank <= top:
            share[rank:] += share[:-rank].copy()
        share *= 0.5
    tail = float(share.sum())
    return 1.0 - tail if below else tail


def _side(upper: float, lower: float, alternative: str) -> float:
    if alternative == "greater":
        return upper
    if alternative == "less":
        return lower
    return min(1.0, 2.0 * min(upper, lower))


def t_test_p(alternative: str = "greater"):
    """Pandas UDF (t, degrees of freedom) -> p."""

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        def one(a, b):
            if pd.isna(a) or pd.isna(b) or b <= 0:
                return None
            upper = t_upper(float(a), float(b))
            return _side(upper, 1.0 - upper, alternative)

        return pd.Series([one(a, b) for a, b in zip(t, df)], dtype="float64")

    return p


#: Pairs up to which ``auto`` takes the exact distribution.
EXACT_PAIRS = 50
#: Pairs for which the exact distribution is still worked out (its sums grow with the square).
MOST_EXACT_PAIRS = 5_000


def wilcoxon_method(n: Column, zeros: Column, ties: Column, method: str = "auto", exact_pairs: int = EXACT_PAIRS) -> Column:
    """Which distribution a test uses: ``exact`` or ``normal``; NULL without pairs.

    ``auto`` is exact for up to ``exact_pairs`` pairs with neither ties nor dropped zeros, else
    normal without continuity correction. Asking for ``exact`` where it does not hold (ties,
    zeros, or more than ``MOST_EXACT_PAIRS`` pairs) is an error.
    """
    plain = ~F.coalesce(ties, F.lit(False)) & (F.coalesce(zeros, F.lit(0)) == 0)
    if method == "auto":
        return F.when(n >= 1, F.when(plain & (n <= exact_pairs), "exact").otherwise("normal"))
    if method == "exact":
        problem = F.raise_error(F.lit("exact signed-rank p needs no ties, no zeros and few pairs")).cast("string")
        return F.when(n >= 1, F.when(plain & (n <= MOST_EXACT_PAIRS), "exact").otherwise(problem))
    return F.when(n >= 1, F.lit("normal"))


def wilcoxon_p(alternative: str = "greater"):
    """Pandas UDF (W+, n, z, method) -> p."""

    @F.pandas_udf("double")
    def p(w: pd.Series, n: pd.Series, z: pd.Series, method: pd.Series) -> pd.Series:
        def one(w_, n_, z_, method_):
            if pd.isna(w_) or pd.isna(n_) or n_ < 1:
                return None
            if method_ == "exact":
                n_ = int(n_)
                upper = signed_rank_upper(float(w_), n_)
                lower = signed_rank_upper(n_ * (n_ + 1) / 2.0 - float(w_), n_)
            elif pd.isna(z_):
                return None
            else:
                upper, lower = normal_upper(float(z_)), normal_upper(-float(z_))
            return _side(upper, lower, alternative)

        return pd.Series(
            [one(*r) for r in zip(w, n, z, method)], dtype="float64"
        )

    return p
