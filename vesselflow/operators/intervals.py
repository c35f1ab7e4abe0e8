"""Exact intervals of the least-squares counterfactual (M4, M6) and Student's t in native expressions.

The prediction of a month outside the fit has two sources of error: the month's own noise and the error of the fitted
line.  With n months before the cut, residual variance s2 on n - 2 degrees of freedom, mean index m and centred sum of
squares Sxx, a single month's error variance is ``s2 (1 + 1/n + (t - m)^2 / Sxx)``; the mean over k months after the cut
has ``s2 (1/k + 1/n + (mean(t) - m)^2 / Sxx)``, because the months share one line.  Totals are k times the mean.

Student's t with whole degrees of freedom v has a finite series in the angle ``a = atan(t / sqrt(v))``: with the
coefficients c(0) = 1 and c(k) = c(k-1) (2k-1) / (2k) for even v, c(k) = c(k-1) 2k / (2k+1) for odd v,

    P(|T| <= t) = sin(a) * sum c(k) cos(a)^(2k)                            even v, k < v / 2
    P(|T| <= t) = 2/pi * (a + sin(a) * sum c(k) cos(a)^(2k+1))             odd v,  k < (v - 1) / 2

The quantile is Newton's method on the angle, where the probability is concave and its slope is a power of the cosine.
One row a series is evaluated; nothing runs in Python workers.

Defined results: fewer than three known months before the cut, or all at one index, give missing bounds; months with a
missing value take part neither in the fit nor in the averages; a perfect fit gives bounds equal to the estimate and a
tail probability of 0, or of 0.5 when the effect is 0 as well; no months after the cut give no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEWTON_STEPS = 30


def _series(cos: Column, df: Column) -> Column:
    """sum c(k) cos^(2k) over the terms that ``df`` has; the accumulator holds the sum and the last term."""
    odd = df % 2
    n = F.floor((df - odd) / 2).cast("int")
    start = F.struct(F.lit(0.0).alias("total"), F.lit(1.0).alias("term"))

    def step(acc, k):
        ratio = (2 * k - 1 + odd) / (2 * k + odd)
        return F.struct((acc["total"] + acc["term"]).alias("total"), (acc["term"] * ratio * cos * cos).alias("term"))

    return F.when(n >= 1, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, step, lambda acc: acc["total"])).otherwise(0.0)


def _within(angle: Column, df: Column) -> Column:
    sin, cos = F.sin(angle), F.cos(angle)
    return F.when(df % 2 == 0, sin * _series(cos, df)).otherwise(F.lit(2 / math.pi) * (angle + sin * cos * _series(cos, df)))


def t_within(t: Column, df: Column) -> Column:
    """P(|T| <= |t|) of Student's t with ``df`` (whole, at least 1) degrees of freedom; missing below that."""
    return F.when(df >= 1, _within(F.atan(F.abs(t) / F.sqrt(df.cast("double"))), df))


def t_quantile(level: float, df: Column) -> Column:
    """t with P(|T| <= t) = ``level``: the half width of a two-sided interval in standard errors."""
    if not 0 < level < 1:
        raise ValueError("level must lie between 0 and 1")
    # slope of the probability in the angle: 2 G((v+1)/2) / (sqrt(pi) G(v/2)) cos^(v-1); the factor as a product over df
    odd = df % 2
    n = F.floor((df - odd) / 2).cast("int")
    first = F.when(odd == 1, F.lit(2 / math.pi)).otherwise(1.0)
    factor = F.when(n >= 1, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), first,
                                        lambda acc, k: acc * F.when(odd == 1, 2 * k / (2 * k - 1))
                                        .otherwise(F.when(k == 1, 1.0).otherwise((2 * k - 1) / (2 * k - 2))))).otherwise(first)
    power = df.cast("double") - 1

    def newton(angle, _):
        return angle + (F.lit(level) - _within(angle, df)) / (factor * F.pow(F.cos(angle), power))

    angle = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0), newton)
    return F.when(df >= 1, F.tan(angle) * F.sqrt(df.cast("double")))


def fit_errors(fitted: DataFrame, level: float = 0.95, key: str = "series_id", y: str = "y", t: str = "t") -> DataFrame:
    """One row a series of :func:`series.linear_counterfactual`: n_pre, residual sd, mean index, Sxx and the t quantile."""
    known = F.col("in_pre") & F.col(y).isNotNull()
    x = F.when(known, F.col(t).cast("double"))
    fit = fitted.groupBy(key).agg(F.count(x).alias("n_pre"), F.avg(x).alias("t_mean"), F.regr_sxx(x, x).alias("t_sxx"),
                                  F.sum(F.when(known, (F.col(y) - F.col("pred")) ** 2)).alias("_sse"))
    df = F.col("n_pre") - 2
    ok = (df >= 1) & (F.col("t_sxx") > 0)
    return (fit.withColumn("resid_sd", F.when(ok, F.sqrt(F.col("_sse") / df)))
               .withColumn("t_crit", F.when(ok, t_quantile(level, df))).drop("_sse"))


def prediction_intervals(fitted: DataFrame, level: float = 0.95, key: str = "series_id", t: str = "t") -> DataFrame:
    """M4: ``pi_lower`` and ``pi_upper`` of every month, the error of the line included.  One row a series is joined back
    on the key the series is already partitioned by."""
    j = fitted.join(fit_errors(fitted, level, key=key, t=t), key, "left")
    half = F.col("t_crit") * F.col("resid_sd") * F.sqrt(1 + 1 / F.col("n_pre") + (F.col(t) - F.col("t_mean")) ** 2 / F.col("t_sxx"))
    return (j.withColumn("pi_lower", F.col("pred") - half).withColumn("pi_upper", F.col("pred") + half)
             .drop("n_pre", "t_mean", "t_sxx", "resid_sd", "t_crit"))


def impact_intervals(fitted: DataFrame, level: float = 0.95, key: str = "series_id", y: str = "y", t: str = "t") -> DataFrame:
    """M6: average and total effect after the cut with their intervals, the interval of the predicted average, the relative
    effect with its interval, and the one-sided tail probability of an effect at least as large."""
    post = F.col("in_post") & F.col(y).isNotNull()
    after = fitted.groupBy(key).agg(
        F.count(F.when(post, 1)).alias("n_post"), F.avg(F.when(post, F.col(t).cast("double"))).alias("_t"),
        F.avg(F.when(post, F.col("pred"))).alias("pred_avg"), F.avg(F.when(post, F.col(y) - F.col("pred"))).alias("effect_avg"))
    j = after.where(F.col("n_post") > 0).join(fit_errors(fitted, level, key, y, t), key)
    se = F.col("resid_sd") * F.sqrt(1 / F.col("n_post") + 1 / F.col("n_pre") + (F.col("_t") - F.col("t_mean")) ** 2 / F.col("t_sxx"))
    j = j.withColumn("effect_se", se).withColumn("_half", F.col("t_crit") * F.col("effect_se"))
    lo, hi, k = F.col("effect_avg") - F.col("_half"), F.col("effect_avg") + F.col("_half"), F.col("n_post")
    ratio = F.try_divide(F.col("effect_avg"), F.col("effect_se"))
    sure = F.when(F.col("effect_avg") == 0, 0.5).otherwise(0.0)
    p = F.when(F.col("effect_se") == 0, sure).otherwise((1 - t_within(ratio, F.col("n_pre") - 2)) / 2)
    base = F.col("pred_avg")
    rel = [F.try_divide(x, base) for x in (lo, hi)]
    return j.select(
        key, "n_pre", "n_post", "resid_sd", "t_crit", "pred_avg",
        (base - F.col("_half")).alias("pred_avg_lower"), (base + F.col("_half")).alias("pred_avg_upper"),
        "effect_avg", "effect_se", lo.alias("effect_avg_lower"), hi.alias("effect_avg_upper"),
        (k * F.col("effect_avg")).alias("effect_sum"), (k * lo).alias("effect_sum_lower"), (k * hi).alias("effect_sum_upper"),
        F.try_divide(F.col("effect_avg"), base).alias("rel_effect"),
        F.least(*rel).alias("rel_lower"), F.greatest(*rel).alias("rel_upper"), p.alias("tail_p"))
