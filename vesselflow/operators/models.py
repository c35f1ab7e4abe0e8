"""Fishing-state classification (M1) and the statistical fits (M5, M7).

M1a is a native expression; M1b is in ``operators.mixture``.
M5 and M7 are grouped-map functions: Spark shuffles one group per series (fleet,
zone, ...) to a Python worker, where numpy runs the fit on that series only; the
scale comes from many series in parallel, never from one large group.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesselflow import constants as C

# --- M1 -------------------------------------------------------------------------------------

DEFAULT_HAULING_MAX_SPEED = 4.0


def classify_by_speed(pings: DataFrame, speed: str = "speed", max_speed: float = DEFAULT_HAULING_MAX_SPEED,
                      min_speed: float | None = None, out: str = "vessel_state") -> DataFrame:
    """``hauling`` when ``min_speed <= speed <= max_speed``, ``steaming`` when
    faster, ``unknown`` when the speed is missing.  A decision of this build: the
    original model is not part of the analysed code."""
    s = F.col(speed)
    slow = s <= F.lit(float(max_speed))
    if min_speed is not None:
        slow = slow & (s >= F.lit(float(min_speed)))
    return pings.withColumn(out, F.when(s.isNull(), "unknown").when(slow, C.HAULING).otherwise("steaming"))


# --- M5: Bayesian structural time series -------------------------------------------------------------

IMPACT_SCHEMA = ("series_id string, date date, t int, y double, in_pre boolean, in_post boolean, "
                 "pred double, lower double, upper double, effect double, cum_effect double, "
                 "cum_lower double, cum_upper double, p_tail double")


def _ig(rng, shape: float, rate: float) -> float:
    """One draw of an inverse-gamma variance."""
    return 1.0 / rng.gamma(shape, 1.0 / rate)


def _sim_smoother(y, Z, T, R_diag, H, P0_diag, rng):
    """One draw of the states given y (Durbin-Koopman simulation smoother) for
    y_t = Z a_t + e_t, a_{t+1} = T_t a_t + u_t with diagonal noise; ``y`` may hold
    NaN (missing).  Univariate observations: every division is by a scalar."""
    n, m = len(y), len(P0_diag)
    # unconditional draw of states and observations
    a = rng.standard_normal(m) * np.sqrt(P0_diag)
    a_plus = np.empty((n, m))
    y_plus = np.empty(n)
    e = rng.standard_normal(n) * np.sqrt(H)
    for t in range(n):
        a_plus[t] = a
        y_plus[t] = Z @ a + e[t]
        a = T[t] @ a + rng.standard_normal(m) * np.sqrt(R_diag[t])
    ys = y - y_plus
    # Kalman filter on y - y_plus
    a = np.zeros(m)
    P = np.diag(P0_diag)
    A = np.empty((n, m)); PP = np.empty((n, m, m))
    V = np.zeros(n); Fv = np.ones(n); KK = np.zeros((n, m)); obs = ~np.isnan(ys)
    for t in range(n):
        A[t], PP[t] = a, P
        Tt = T[t]
        if obs[t]:
            PZ = P @ Z
            f = Z @ PZ + H
            v = ys[t] - Z @ a
            k = Tt @ PZ / f
            V[t], Fv[t], KK[t] = v, f, k
            a = Tt @ a + k * v
            P = Tt @ P @ Tt.T - np.outer(k, k) * f + np.diag(R_diag[t])
        else:
            a = Tt @ a
            P = Tt @ P @ Tt.T + np.diag(R_diag[t])
    # backward smoothing recursion
    r = np.zeros(m)
    hat = np.empty((n, m))
    for t in range(n - 1, -1, -1):
        Tt = T[t]
        if obs[t]:
            r = Z * (V[t] / Fv[t]) + Tt.T @ r - Z * (KK[t] @ r)
        else:
            r = Tt.T @ r
        hat[t] = A[t] + PP[t] @ r
    return a_plus + hat


def bsts_fit(y_pre_post: np.ndarray, x: np.ndarray, observed: np.ndarray, niter: int = C.MCMC_ITERATIONS,
             n_seasons: int = C.N_SEASONS, duration: int = C.SEASON_DURATION, seed: int = 1,
             burn: float = 0.1) -> np.ndarray:
    """Gibbs sampler for local level + seasonal(n_seasons x duration) + static
    regression on ``x``; returns posterior predictive draws of y for every step
    (shape draws x n).  Observations outside ``observed`` are treated as missing."""
    rng = np.random.default_rng(seed)
    y = np.where(observed, y_pre_post, np.nan)
    mu, sd = np.nanmean(y), np.nanstd(y) or 1.0
    ys = (y - mu) / sd
    xs = (x - x.mean()) / (x.std() or 1.0)
    n = len(ys)
    m = 1 + (n_seasons - 1)
    Z = np.zeros(m); Z[0] = 1.0; Z[1] = 1.0
    T_season = np.zeros((m, m)); T_season[0, 0] = 1.0
    T_season[1, 1:] = -1.0
    for j in range(2, m):
        T_season[j, j - 1] = 1.0
    T_hold = np.eye(m)
    boundary = np.array([(t + 1) % duration == 0 for t in range(n)])
    T = np.array([T_season if b else T_hold for b in boundary])
    s_level, s_season, s_obs, beta = 0.01, 0.01, 0.5, 0.0
    # priors on the standardised scale: state sds guess 0.01 (32 pseudo-observations,
    # capped at 1 = the data's sd); observation sd guess sqrt(1 - expected R2 of 0.8)
    # with 50 pseudo-observations
    prior_n, level_guess, sd_cap = 32.0, 0.01, 1.0
    obs_n, obs_guess = 50.0, float(np.sqrt(1.0 - 0.8))
    keep = []
    obs_idx = ~np.isnan(ys)
    for it in range(niter):
        R = np.zeros((n, m))
        R[:, 0] = s_level ** 2
        R[boundary, 1] = s_season ** 2
        states = _sim_smoother(ys - beta * xs, Z, T, R, s_obs ** 2, np.full(m, 10.0), rng)
        lvl = states[:, 0]
        d_lvl = np.diff(lvl)
        s_level = min(sd_cap, np.sqrt(_ig(rng, (prior_n + len(d_lvl)) / 2,
                                          (prior_n * level_guess ** 2 + d_lvl @ d_lvl) / 2)))
        sea = states[:, 1]
        bidx = np.where(boundary[:-1])[0]
        pred_sea = -states[bidx, 1:].sum(axis=1)
        d_sea = sea[bidx + 1] - pred_sea
        s_season = min(sd_cap, np.sqrt(_ig(rng, (prior_n + len(d_sea)) / 2,
                                           (prior_n * level_guess ** 2 + d_sea @ d_sea) / 2)))
        fit = states @ Z
        r = (ys - fit)[obs_idx]
        xo = xs[obs_idx]
        prec = xo @ xo / s_obs ** 2 + 1.0
        beta = rng.normal((xo @ r / s_obs ** 2) / prec, 1 / np.sqrt(prec))
        e = r - beta * xo
        s_obs = np.sqrt(_ig(rng, (obs_n + len(e)) / 2, (obs_n * obs_guess ** 2 + e @ e) / 2))
        if it >= burn * niter:
            keep.append((fit + beta * xs + rng.normal(0, s_obs, n)) * sd + mu)
    return np.array(keep)


def _posterior(pdf: pd.DataFrame, niter: int, n_seasons: int, duration: int, seed: int):
    """Sorted series, its values, posterior predictive draws and the post mask."""
    pdf = pdf.sort_values("date").reset_index(drop=True)
    y = pdf["y"].to_numpy(dtype=float)
    observed = pdf["in_pre"].to_numpy(dtype=bool) & ~np.isnan(y)
    sid = str(pdf["series_id"].iloc[0])
    series_seed = seed + zlib.crc32(sid.encode())
    if observed.sum() < 3:                     # nothing to fit: predictions stay missing
        draws = np.full((max(1, niter - int(0.1 * niter)), len(y)), np.nan)
    else:
        draws = bsts_fit(y, pdf["t"].to_numpy(dtype=float), observed, niter, n_seasons, duration, series_seed)
    return pdf, y, draws, pdf["in_post"].to_numpy(dtype=bool)


def _impact_group(pdf: pd.DataFrame, niter: int, n_seasons: int, duration: int, seed: int) -> pd.DataFrame:
    pdf, y, draws, post = _posterior(pdf, niter, n_seasons, duration, seed)
    eff_draws = np.where(post, y - draws, np.nan)
    cum = np.nancumsum(np.where(post, eff_draws, 0.0), axis=1)
    cum = np.where(post, cum, np.nan)
    out = pdf[["series_id", "date", "t", "y", "in_pre", "in_post"]].copy()
    out["pred"] = draws.mean(axis=0)
    out["lower"] = np.quantile(draws, 0.025, axis=0)
    out["upper"] = np.quantile(draws, 0.975, axis=0)
    out["effect"] = np.where(post, y - out["pred"], np.nan)
    with np.errstate(invalid="ignore"):
        out["cum_effect"] = np.where(post, np.mean(np.where(post, cum, 0.0), axis=0), np.nan)
        out["cum_lower"] = np.where(post, np.nanquantile(np.where(post, cum, 0.0), 0.025, axis=0), np.nan)
        out["cum_upper"] = np.where(post, np.nanquantile(np.where(post, cum, 0.0), 0.975, axis=0), np.nan)
        last = cum[:, post][:, -1] if post.any() else np.full(len(draws), np.nan)
        p = min((last >= 0).mean(), (last <= 0).mean()) if post.any() else np.nan
    out["p_tail"] = p
    out["t"] = out["t"].astype("int32")
    return out


SUMMARY_SCHEMA = ("series_id string, n_post long, actual_avg double, pred_avg double, pred_avg_lower double, "
                  "pred_avg_upper double, effect_avg double, effect_avg_lower double, effect_avg_upper double, "
                  "rel_effect double, rel_lower double, rel_upper double, actual_sum double, pred_sum double, "
                  "effect_sum double, effect_sum_lower double, effect_sum_upper double, p_tail double")


def _summary_group(pdf: pd.DataFrame, niter: int, n_seasons: int, duration: int, seed: int) -> pd.DataFrame:
    pdf, y, draws, post = _posterior(pdf, niter, n_seasons, duration, seed)
    m = post & ~np.isnan(y)
    sid = str(pdf["series_id"].iloc[0])
    if not m.any():
        return pd.DataFrame([{"series_id": sid, "n_post": 0}], columns=SUMMARY_SCHEMA_COLS)
    pred_avg = draws[:, m].mean(axis=1)                   # one value per draw
    pred_sum = draws[:, m].sum(axis=1)
    act_avg, act_sum = y[m].mean(), y[m].sum()
    eff_avg, eff_sum = act_avg - pred_avg, act_sum - pred_sum
    with np.errstate(divide="ignore", invalid="ignore"):
        rel = eff_sum / pred_sum
    q = lambda a, p: float(np.quantile(a, p))           # noqa: E731
    row = {"series_id": sid, "n_post": int(m.sum()), "actual_avg": act_avg, "pred_avg": float(pred_avg.mean()),
           "pred_avg_lower": q(pred_avg, 0.025), "pred_avg_upper": q(pred_avg, 0.975),
           "effect_avg": float(eff_avg.mean()), "effect_avg_lower": q(eff_avg, 0.025),
           "effect_avg_upper": q(eff_avg, 0.975), "rel_effect": float(np.mean(rel)),
           "rel_lower": q(rel, 0.025), "rel_upper": q(rel, 0.975), "actual_sum": act_sum,
           "pred_sum": float(pred_sum.mean()), "effect_sum": float(eff_sum.mean()),
           "effect_sum_lower": q(eff_sum, 0.025), "effect_sum_upper": q(eff_sum, 0.975),
           "p_tail": float(min((eff_sum >= 0).mean(), (eff_sum <= 0).mean()))}
    return pd.DataFrame([row], columns=SUMMARY_SCHEMA_COLS)


SUMMARY_SCHEMA_COLS = [c.split()[0] for c in SUMMARY_SCHEMA.split(", ")]


def bayesian_summary(series: DataFrame, niter: int = C.MCMC_ITERATIONS, n_seasons: int = C.N_SEASONS,
                     duration: int = C.SEASON_DURATION, seed: int = 2017) -> DataFrame:
    """M6 for M5: per series, post-period average and total of actual, prediction and
    effect, the relative effect, 95% intervals from the posterior draws, and the
    one-sided tail probability of the total effect."""
    from vesselflow.session import ship_package
    ship_package(series.sparkSession)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        return _summary_group(pdf, niter, n_seasons, duration, seed)
    cols = series.select("series_id", "date", "t", "y", "in_pre", "in_post")
    return cols.groupBy("series_id").applyInPandas(fn, SUMMARY_SCHEMA)


def bayesian_impact(series: DataFrame, niter: int = C.MCMC_ITERATIONS, n_seasons: int = C.N_SEASONS,
                    duration: int = C.SEASON_DURATION, seed: int = 2017) -> DataFrame:
    """M5: structural time-series counterfactual per series (one grouped-map task per
    series; a series is one row per month, so a group is bounded by the calendar).
    Input columns: series_id, date, t, y, in_pre, in_post."""
    from vesselflow.session import ship_package
    ship_package(series.sparkSession)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        return _impact_group(pdf, niter, n_seasons, duration, seed)
    cols = series.select("series_id", "date", "t", "y", "in_pre", "in_post")
    return cols.groupBy("series_id").applyInPandas(fn, IMPACT_SCHEMA)


# --- M7: smoothed trend, Gamma family with log link ------------------------------------------------------

TREND_SCHEMA = "series_id string, period string, date date, y double, trend double"


def _spline_basis(x: np.ndarray, n_knots: int) -> np.ndarray:
    """Truncated-power cubic basis with knots at quantiles of x."""
    x = (x - x.min()) / ((x.max() - x.min()) or 1.0)
    knots = np.quantile(x, np.linspace(0, 1, n_knots + 2)[1:-1]) if n_knots > 0 else np.array([])
    cols = [np.ones_like(x), x, x ** 2, x ** 3] + [np.clip(x - k, 0, None) ** 3 for k in knots]
    return np.column_stack(cols)


def gamma_log_fit(x: np.ndarray, y: np.ndarray, n_knots: int = 4, lam: float = 1.0, iters: int = 50) -> np.ndarray:
    """Penalised IRLS for a Gamma GLM with log link on a cubic spline basis; returns
    fitted means.  The smoothing weight is fixed (no smoothness selection)."""
    B = _spline_basis(x, min(n_knots, max(len(x) - 4, 0)))
    pen = np.eye(B.shape[1]) * lam
    pen[:2, :2] = 0.0
    mu = np.full_like(y, y.mean())
    eta = np.log(mu)
    for _ in range(iters):
        z = eta + (y - mu) / mu          # working response; Gamma/log weights are 1
        beta = np.linalg.solve(B.T @ B + pen, B.T @ z)
        eta_new = B @ beta
        if np.max(np.abs(eta_new - eta)) < 1e-8:
            eta = eta_new
            break
        eta = eta_new
        mu = np.exp(eta)
    return np.exp(eta)


def gamma_trend(df: DataFrame, keys: list, y: str = "y", date: str = "date") -> DataFrame:
    """M7: trend per (series, period) group fitted in a grouped-map task; rows with
    y <= 0 or missing are not fitted (the Gamma family needs y > 0)."""
    k1, k2 = keys

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date)
        ok = pdf["y"].notna() & (pdf["y"] > 0)
        out = pd.DataFrame({"series_id": pdf[k1].astype(str), "period": pdf[k2].astype(str),
                            "date": pdf[date], "y": pdf["y"], "trend": np.nan})
        if ok.sum() >= 2:
            x = pd.to_datetime(pdf.loc[ok, date]).map(pd.Timestamp.toordinal).to_numpy(dtype=float)
            out.loc[ok, "trend"] = gamma_log_fit(x, pdf.loc[ok, "y"].to_numpy(dtype=float))
        return out

    from vesselflow.session import ship_package
    ship_package(df.sparkSession)
    src = df.select(F.col(k1), F.col(k2), F.col(date), F.col(y).cast("double").alias("y"))
    return src.groupBy(k1, k2).applyInPandas(fn, TREND_SCHEMA)
