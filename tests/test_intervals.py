"""Exact intervals, gap runs, expected lengths and port cells against brute force."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vesselflow.operators import geo, intervals, series

# Two-sided 95 % points of Student's t, from printed tables.
T95 = {1: 12.7062, 2: 4.30265, 3: 3.18245, 5: 2.57058, 10: 2.22814, 30: 2.04227, 57: 2.00247, 100: 1.98397}


def _within(t, df):
    """P(|T| <= t) by Simpson's rule over the density."""
    x = np.linspace(0, t, 20001)
    log_c = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    f = np.exp(log_c - (df + 1) / 2 * np.log1p(x * x / df))
    return 2 * (x[1] - x[0]) / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum())


def test_student_t(spark):
    d = spark.createDataFrame([(k, v) for k, v in T95.items()] + [(0, 1.0), (-1, 1.0)], "df int, t double")
    rows = d.select("*", intervals.t_quantile(0.95, F.col("df")).alias("q"), intervals.t_within(F.col("t") / 2, F.col("df")).alias("p")).collect()
    for r in rows:
        if r.df < 1:
            assert r.q is None and r.p is None
            continue
        assert r.q == pytest.approx(T95[r.df], rel=1e-5)
        assert r.p == pytest.approx(_within(r.t / 2, r.df), abs=1e-9)
    for level in (0.5, 0.8, 0.99, 0.999):
        q = d.where("df > 0").select("df", intervals.t_quantile(level, F.col("df")).alias("q")).collect()
        assert all(_within(r.q, r.df) == pytest.approx(level, abs=1e-6) for r in q if r.df > 2)


def _fitted(spark, rows, pre=("2000-01-01", "2002-12-01"), post=("2003-01-01", "2004-12-01")):
    s = spark.createDataFrame(rows, "series_id string, date date, y double")
    return series.linear_counterfactual(series.flag_periods(series.time_index(s), pre, post))


def _months(n, start=2000):
    return [dt.date(start + k // 12, k % 12 + 1, 1) for k in range(n)]


def test_intervals_against_matrix_algebra(spark):
    rng = random.Random(3)
    rows = [("a", d, 5 + 0.3 * k + rng.gauss(0, 2) + (4 if k >= 36 else 0)) for k, d in enumerate(_months(60))]
    rows += [("b", d, None if k % 7 == 3 else rng.gauss(0, 1)) for k, d in enumerate(_months(48))]
    f = _fitted(spark, rows)
    points = {(r.series_id, r.date): r for r in intervals.prediction_intervals(f).collect()}
    total = {r.series_id: r for r in intervals.impact_intervals(f).collect()}
    for name in ("a", "b"):
        y = [(k + 1, d, v) for k, (n, d, v) in enumerate([r for r in rows if r[0] == name])]
        pre = [(t, v) for t, d, v in y if d <= dt.date(2002, 12, 1) and v is not None]
        post = [(t, v) for t, d, v in y if dt.date(2003, 1, 1) <= d <= dt.date(2004, 12, 1) and v is not None]
        x = np.array([[1, t] for t, _ in pre], float)
        v = np.array([v for _, v in pre])
        beta, inv = np.linalg.lstsq(x, v, rcond=None)[0], np.linalg.inv(x.T @ x)
        s2 = ((v - x @ beta) ** 2).sum() / (len(pre) - 2)
        crit = total[name].t_crit
        assert _within(crit, len(pre) - 2) == pytest.approx(0.95, abs=1e-7)
        for t, d, _ in y:
            row = np.array([1, t])
            half = crit * math.sqrt(s2 * (1 + row @ inv @ row))
            got = points[name, d]
            assert (got.pi_lower, got.pi_upper) == (pytest.approx(row @ beta - half), pytest.approx(row @ beta + half))
        z = np.array([[1, t] for t, _ in post], float)
        w = np.full(len(post), 1 / len(post))
        effect = float(w @ (np.array([v for _, v in post]) - z @ beta))
        se = math.sqrt(s2 * (w @ (np.eye(len(post)) + z @ inv @ z.T) @ w))
        r = total[name]
        assert (r.n_pre, r.n_post) == (len(pre), len(post))
        assert (r.effect_avg, r.effect_se) == (pytest.approx(effect), pytest.approx(se))
        assert r.effect_sum_lower == pytest.approx(len(post) * (effect - crit * se))
        assert r.tail_p == pytest.approx((1 - _within(abs(effect) / se, len(pre) - 2)) / 2, abs=1e-8)


def test_interval_corner_cases(spark):
    m = _months(48)
    rows = [("short", d, float(k)) for k, d in enumerate(m[34:38])] + [("line", d, 2.0 * k) for k, d in enumerate(m)]
    rows += [("before", d, float(k * k)) for k, d in enumerate(m[:20])] + [("unknown", d, None) for d in m]
    got = {r.series_id: r for r in intervals.impact_intervals(_fitted(spark, rows)).collect()}
    assert set(got) == {"short", "line"}
    assert got["short"].t_crit is None and got["short"].effect_avg_lower is None and got["short"].tail_p is None
    assert got["line"].effect_avg_lower == pytest.approx(0, abs=1e-9) and 0 <= got["line"].tail_p <= 0.5
    assert intervals.impact_intervals(_fitted(spark, [])).count() == 0
    points = [r for r in intervals.prediction_intervals(_fitted(spark, rows)).collect() if r.series_id == "short"]
    assert len(points) == 4 and all(r.pi_lower is None for r in points)


def test_gap_runs(spark):
    rng = random.Random(4)
    rows, want = [], set()
    calendar = _months(40)
    for name in ("a", "b", None):
        known = [rng.random() < 0.6 for _ in calendar]
        for d, ok in zip(calendar, known):
            if ok:
                rows += [(name, d.replace(day=rng.randint(1, 28)), 1.0)] * rng.randint(1, 2)
            elif rng.random() < 0.5:
                rows.append((name, d, None))
        rows.append((name, dt.date(1999, 5, 1), 1.0))
        start = 0
        for k in range(1, 41):
            if k == 40 or known[k] != known[start]:
                want.add((name, calendar[start], calendar[k - 1], k - start, known[start]))
                start = k
    s = spark.createDataFrame(rows, "series_id string, date date, y double")
    got = series.gap_runs(s, "2000-01-15", "2003-04-02").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert series.gap_runs(s.limit(0), "2000-01-01", "2001-01-01").count() == 0


def test_expected_counts(spark):
    s = spark.createDataFrame([("cpue_yes",), ("cpue_no",), ("cpue_no",), ("area_yes",), ("area_no",), ("area_no",), ("activity",), (None,)], "series_id string")
    got = {tuple(r) for r in series.expected_counts(s, {"cpue_pair": 3, "area_series": 2, "other": 5}).collect()}
    assert got == {("cpue_pair", 3, 3, True), ("area_yes", 1, 2, False), ("area_no", 2, 2, True), ("other", 0, 5, False)}
    series.require_expected(series.expected_counts(s, {"cpue_pair": 3}))
    with pytest.raises(ValueError, match="area_yes: 1 rows, expected 2"):
        series.require_expected(series.expected_counts(s, {"area_series": 2}))


@pytest.mark.parametrize("radius", [5.0, 60.0, 400.0])
def test_port_cells_equal_all_distances(spark, radius):
    rng = random.Random(int(radius))
    ports = [(rng.uniform(-180, 180), rng.choice([rng.uniform(-90, 90), rng.uniform(84, 90), -89.99, 89.97])) for _ in range(150)]
    ports += [(179.99, 10.0), (-179.99, -60.0), (180.0, 0.0), (0.0, 90.0), (None, 3.0), (12.0, None)]
    points = []
    for plon, plat in [p for p in ports if None not in p] * 4:           # around the rim of every circle, and across the date line
        d, a = radius / 111.195 * rng.choice([0.3, 0.98, 0.999, 1.001, 1.02]), rng.uniform(0, 2 * math.pi)
        lat = max(-90.0, min(90.0, plat + d * math.cos(a)))
        lon = plon + d * math.sin(a) / max(0.001, math.cos(math.radians(plat)))
        points.append((len(points), (lon + 180) % 360 - 180, lat))
    points += [(len(points), None, 5.0), (len(points) + 1, 5.0, None), (len(points) + 2, 190.0, 10.0)]
    p = spark.createDataFrame(points, "k int, longitude double, latitude double")
    q = spark.createDataFrame(ports, "longitude double, latitude double")

    def near(lon, lat):
        if lon is None or lat is None:
            return False
        for plon, plat in ports:
            if plon is None or plat is None:
                continue
            f1, f2 = math.radians(lat), math.radians(plat)
            h = math.sin((f2 - f1) / 2) ** 2 + math.cos(f1) * math.cos(f2) * math.sin(math.radians(plon - lon) / 2) ** 2
            if 2 * geo.EARTH_RADIUS_KM * math.asin(min(1, math.sqrt(h))) <= radius:
                return True
        return False

    want = {k: "port_visit" if near(lon, lat) else "at_sea" for k, lon, lat in points}
    for strategy in ("broadcast", "shuffle"):
        got = geo.flag_port_visits(p, q, radius_km=radius, strategy=strategy)
        assert got.columns == p.columns + ["location"]
        assert {r.k: r.location for r in got.collect()} == want
    if radius == 5.0:
        widest = geo.port_cells(q.where("abs(latitude) < 80"), radius).agg(F.max(F.size("_ports"))).first()[0]
        assert widest <= 8                                              # ports measured for one position, of 150 in all
