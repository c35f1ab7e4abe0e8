"""M1b by expectation maximisation in Spark: against a numpy loop over the raw speeds, and its edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vesselflow import constants as C
from vesselflow.operators import mixture


def _numpy_fit(x, steps):
    """The textbook loop over single speeds, with densities and not their logarithms."""
    w, m, v = np.array([.5, .5]), np.array([x.mean() - x.std(), x.mean() + x.std()]), np.array([x.var(), x.var()])
    for _ in range(steps):
        dens = w * np.exp(-(x[:, None] - m) ** 2 / (2 * v)) / np.sqrt(2 * np.pi * v)
        r = dens / dens.sum(1, keepdims=True)
        n = r.sum(0)
        w, m = n / len(x), (r * x[:, None]).sum(0) / n
        v = (r * (x[:, None] - m) ** 2).sum(0) / n
    return w, m, v


def _frame(spark, speeds):
    return spark.createDataFrame([(None if s is None else float(s),) for s in speeds], "speed double")


@pytest.mark.parametrize("steps", [1, 5, 25])
def test_equals_the_loop_over_single_speeds(spark, steps):
    rng = np.random.default_rng(3)
    x = np.round(np.concatenate([rng.normal(2.5, .8, 300), rng.normal(8, 1.5, 500)]), 1)
    got = mixture.fit(mixture.speed_histogram(_frame(spark, x)), iterations=steps, tolerance=-math.inf)
    w, m, v = _numpy_fit(x, steps)
    assert np.allclose(got, [w[0], m[0], v[0], w[1], m[1], v[1]], rtol=1e-9)


def test_likelihood_never_falls_and_the_fit_stops(spark):
    rng = np.random.default_rng(5)
    x = np.round(np.concatenate([rng.normal(3, .5, 200), rng.normal(9, 1, 100)]), 1)
    h = mixture.speed_histogram(_frame(spark, x))
    p, likes = mixture.start(h), []
    for _ in range(12):
        p, like = mixture.step(h, p)
        likes.append(like)
    assert all(b >= a - 1e-12 for a, b in zip(likes, likes[1:]))
    done = mixture.fit(h)
    assert abs(done.m1 - 3) < .2 and abs(done.m2 - 9) < .3 and abs(done.w1 - 2 / 3) < .02


def test_missing_infinite_and_no_speeds(spark):
    x = [1.0, 1.2, 1.1, 9.0, 9.3, None, float("nan"), float("inf")]
    got = [r.vessel_state for r in mixture.classify_by_mixture(_frame(spark, x), location=None).collect()]
    assert got == [C.HAULING] * 3 + ["steaming"] * 2 + ["unknown"] * 3
    for none in ([], [None, float("nan")]):
        assert mixture.fit(mixture.speed_histogram(_frame(spark, none))) is None
        out = mixture.classify_by_mixture(_frame(spark, none), location=None)
        assert [r.vessel_state for r in out.collect()] == ["unknown"] * len(none)


def test_one_repeated_speed(spark):
    got = mixture.classify_by_mixture(_frame(spark, [4.0] * 50), location=None)
    p = mixture.fit(mixture.speed_histogram(_frame(spark, [4.0] * 50)))
    assert all(math.isfinite(v) for v in p) and p.v1 >= mixture.MIN_VARIANCE
    assert got.count() == 50 and got.where(F.col("vessel_state").isNull()).isEmpty()


def test_far_outlier_does_not_overflow(spark):
    p = mixture.fit(mixture.speed_histogram(_frame(spark, [1.0] * 500 + [1.5] * 500 + [1e6])))
    assert all(math.isfinite(v) for v in p) and p.m2 > 1e5


def test_port_visits_take_no_part(spark):
    rows = [(1.0, "at_sea")] * 20 + [(8.0, "at_sea")] * 20 + [(0.0, C.PORT_VISIT)] * 500 + [(1.0, None)]
    df = spark.createDataFrame(rows, "speed double, location string")
    h = {r.x: r.n for r in mixture.speed_histogram(df, location="location").collect()}
    assert h == {1.0: 21, 8.0: 20}
    out = {(r.speed, r.vessel_state) for r in mixture.classify_by_mixture(df).collect()}
    assert out == {(1.0, C.HAULING), (8.0, "steaming"), (0.0, "port")}
