"""Two-component Gaussian mixture on speed (M1b), fitted by expectation maximisation as Spark aggregates.

The pings are read once, into a histogram of the distinct speeds (its size is the speed resolution, not the number of
pings); for one dimension its weighted likelihood is that of all pings.  Every iteration is one aggregate over the written histogram
that returns one row of sums; the driver holds the six parameters.  The start is fixed by the histogram's mean and variance, so the fit
has no seed and can be repeated by any engine.

Defined results: a missing or non-finite speed takes no part in the fit; with no speed at all there is no fit (``None``);
equal speeds give two equal components with the variance floor.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesselflow import constants as C
from vesselflow.operators.membership import materialize

ITERATIONS, TOLERANCE = 200, 1e-9
MIN_VARIANCE = 1e-6         # a component on one repeated speed keeps this spread
MAX_EXPONENT = 700.0        # exp() of more leaves the range of doubles


class Mixture(NamedTuple):
    """Weight, mean and variance of the slow and the fast component."""

    w1: float
    m1: float
    v1: float
    w2: float
    m2: float
    v2: float


def speed_histogram(pings: DataFrame, speed: str = "speed", location: str | None = None) -> DataFrame:
    """(x, n): the distinct speeds and their pings, reduced on the mappers; port visits are left out when flagged."""
    rows = pings.where(F.col(speed).isNotNull() & ~F.isnan(speed) & (F.abs(speed) != F.lit(float("inf"))))
    if location:
        rows = rows.where(~F.col(location).eqNullSafe(C.PORT_VISIT))
    return rows.groupBy(F.col(speed).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))


def log_odds(x: Column, p: Mixture) -> Column:
    """Log of the posterior odds of the fast component against the slow one."""
    def log_density(w, m, v):
        return F.lit(math.log(w) if w > 0 else -MAX_EXPONENT) - F.lit(0.5 * math.log(v)) - (x - F.lit(m)) * (x - F.lit(m)) / F.lit(2 * v)

    return log_density(p.w2, p.m2, p.v2) - log_density(p.w1, p.m1, p.v1)


def start(histogram: DataFrame) -> Mixture | None:
    """Equal weights, means one deviation off the mean, both with the whole variance."""
    n, sx, sxx = histogram.agg(F.sum("n"), F.sum(F.col("n") * F.col("x")), F.sum(F.col("n") * F.col("x") * F.col("x"))).first()
    if not n:
        return None
    mean = sx / n
    var = max(sxx / n - mean * mean, MIN_VARIANCE)
    return Mixture(0.5, mean - math.sqrt(var), var, 0.5, mean + math.sqrt(var), var)


def step(histogram: DataFrame, p: Mixture) -> tuple[Mixture, float]:
    """One iteration: the next parameters and the mean log likelihood (but for a constant) under ``p``."""
    x, n = F.col("x"), F.col("n")
    odds = log_odds(x, p)
    slow = F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(F.lit(MAX_EXPONENT), odds)))
    own = F.lit((math.log(p.w1) if p.w1 > 0 else -MAX_EXPONENT) - 0.5 * math.log(p.v1)) - (x - F.lit(p.m1)) * (x - F.lit(p.m1)) / F.lit(2 * p.v1)
    # log(e^a + e^b) from the larger of the two, so that neither overflows
    both = own + F.greatest(odds, F.lit(0.0)) + F.log1p(F.exp(-F.abs(odds)))
    sums = []
    for share, m in ((n * slow, p.m1), (n * (F.lit(1.0) - slow), p.m2)):
        sums += [F.sum(share), F.sum(share * (x - F.lit(m))), F.sum(share * (x - F.lit(m)) * (x - F.lit(m)))]
    total, like, *got = histogram.agg(F.sum("n"), F.sum(n * both), *[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()

    def component(count, first, second, mean, var):
        if count <= 0:                                      # nothing belongs to it any more
            return 0.0, mean, var
        shift = first / count
        return count / total, mean + shift, max(second / count - shift * shift, MIN_VARIANCE)

    return Mixture(*component(*got[:3], p.m1, p.v1), *component(*got[3:], p.m2, p.v2)), like / total


def fit(histogram: DataFrame, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> Mixture | None:
    """Iterate until the mean log likelihood gains less than ``tolerance`` or ``iterations`` are done; the slower mean comes first."""
    histogram = materialize(histogram).coalesce(1)          # distinct speeds: a few thousand rows, summed without a shuffle
    p, before = start(histogram), -math.inf
    if p is None:
        return None
    for _ in range(iterations):
        p, like = step(histogram, p)
        if like - before < tolerance:
            break
        before = like
    return p if p.m1 <= p.m2 else Mixture(*p[3:], *p[:3])


def mixture_state(speed: Column, p: Mixture | None) -> Column:
    """``hauling`` when the slow component is at least as likely, ``steaming`` otherwise, ``unknown`` without a finite speed."""
    unknown = speed.isNull() | F.isnan(speed) | (F.abs(speed) == F.lit(float("inf")))
    if p is None:
        return F.lit("unknown")
    return F.when(unknown, "unknown").when(log_odds(speed, p) <= 0, C.HAULING).otherwise("steaming")


def classify_by_mixture(pings: DataFrame, speed: str = "speed", out: str = "vessel_state", location: str | None = "location",
                        iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """Fishing state of every ping from the fitted mixture; port visits, when flagged, take no part in the fit and never haul.
    Scoring compares two log densities per ping: no join, no Python."""
    has_loc = bool(location) and location in pings.columns
    p = fit(speed_histogram(pings, speed, location if has_loc else None), iterations, tolerance)
    state = mixture_state(F.col(speed), p)
    if has_loc:
        state = F.when(F.col(location) == C.PORT_VISIT, "port").otherwise(state)
    return pings.withColumn(out, state)


def components(p: Mixture | None, spark) -> DataFrame:
    """(component, weight, mean, sd): the fitted parameters as a table."""
    rows = [] if p is None else [(C.HAULING, p.w1, p.m1, math.sqrt(p.v1)), ("steaming", p.w2, p.m2, math.sqrt(p.v2))]
    return spark.createDataFrame(rows, "component string, weight double, mean double, sd double")
