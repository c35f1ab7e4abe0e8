"""Statistical operators on synthetic series with known answers."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from vesselflow.operators import mixture, models, series


def _series(spark, ys, sid="s"):
    start = dt.date(2000, 1, 1)
    data = [(sid, dt.date(start.year + (start.month - 1 + i) // 12, (start.month - 1 + i) % 12 + 1, 1), float(y))
            for i, y in enumerate(ys)]
    return spark.createDataFrame(data, "series_id string, date date, y double")


def test_linear_counterfactual_recovers_step(spark):
    ys = [1.0 + 0.5 * t for t in range(1, 25)] + [1.0 + 0.5 * t + 3.0 for t in range(25, 37)]
    s = series.time_index(_series(spark, ys))
    s = series.flag_periods(s, ("2000-01-01", "2001-12-01"), ("2002-01-01", "2002-12-01"))
    fit = series.linear_counterfactual(s)
    post = fit.where("in_post").select("effect", "cum_effect", "t").orderBy("t").collect()
    assert all(abs(r["effect"] - 3.0) < 1e-9 for r in post)
    assert abs(post[-1]["cum_effect"] - 36.0) < 1e-9
    summ = series.impact_summary(fit).first()
    assert summ["n_post"] == 12 and abs(summ["effect_avg"] - 3.0) < 1e-9


def test_bayesian_impact_interval_covers_step(spark):
    rng = np.random.default_rng(0)
    ys = list(5.0 + rng.normal(0, 0.1, 48)) + list(9.0 + rng.normal(0, 0.1, 12))
    s = series.time_index(_series(spark, ys))
    s = series.flag_periods(s, ("2000-01-01", "2003-12-01"), ("2004-01-01", "2004-12-01"))
    out = models.bayesian_impact(s, niter=200, n_seasons=4, duration=1).toPandas()
    post = out[out.in_post]
    assert len(out) == 60
    assert (post.effect > 2.0).all()
    assert (post.upper < post.y).all()           # actual above the 95% band: a real effect
    assert post.p_tail.iloc[0] < 0.05


def test_gamma_trend_recovers_constant(spark):
    df = spark.createDataFrame([("a", "Before", dt.date(2000, m, 1), 2.5) for m in range(1, 13)],
                               "series_id string, period string, date date, y double")
    out = models.gamma_trend(df, ["series_id", "period"]).toPandas()
    assert np.allclose(out.trend, 2.5, rtol=1e-6)


def test_mixture_separates_speed_clusters(spark):
    rng = np.random.default_rng(1)
    speeds = list(rng.normal(2.0, 0.3, 200)) + list(rng.normal(10.0, 0.5, 200))
    df = spark.createDataFrame([(float(s),) for s in speeds], "speed double")
    out = mixture.classify_by_mixture(df, location=None)
    slow = out.where(F.col("speed") < 5).where(F.col("vessel_state") == "hauling").count()
    fast = out.where(F.col("speed") > 5).where(F.col("vessel_state") == "steaming").count()
    assert slow == 200 and fast == 200


def test_speed_band_rule(spark):
    df = spark.createDataFrame([(1.0,), (4.0,), (4.5,), (None,)], "speed double")
    got = [r[0] for r in models.classify_by_speed(df).select("vessel_state").collect()]
    assert got == ["hauling", "hauling", "steaming", "unknown"]


def test_bayesian_summary_interval_excludes_zero(spark):
    rng = np.random.default_rng(0)
    ys = list(5.0 + rng.normal(0, 0.1, 48)) + list(9.0 + rng.normal(0, 0.1, 12))
    s = series.time_index(_series(spark, ys))
    s = series.flag_periods(s, ("2000-01-01", "2003-12-01"), ("2004-01-01", "2004-12-01"))
    r = models.bayesian_summary(s, niter=200, n_seasons=4, duration=1).first()
    assert r["n_post"] == 12
    assert r["effect_avg_lower"] > 0 and abs(r["effect_avg"] - 4.0) < 1.0
    assert r["p_tail"] < 0.05 and r["rel_lower"] > 0


def test_bayesian_fit_tolerates_unfittable_series(spark):
    import datetime as dt
    rows = [("empty", dt.date(2000, m, 1), None) for m in range(1, 13)]
    s = spark.createDataFrame(rows, "series_id string, date date, y double")
    s = series.flag_periods(series.time_index(s), ("2000-01-01", "2000-08-01"), ("2000-09-01", "2000-12-01"))
    out = models.bayesian_impact(s, niter=20, n_seasons=4, duration=1).toPandas()
    assert len(out) == 12 and out.pred.isna().all()
    summ = models.bayesian_summary(s, niter=20, n_seasons=4, duration=1).toPandas()
    assert len(summ) == 1 and summ.n_post.iloc[0] == 0
