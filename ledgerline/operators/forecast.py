"""Time-series forecasting per series key.

Input series are first aggregated by Spark to one row per (key, period), so
a series' length is bounded by the calendar span, not by the data volume
(a key holding a third of all rows still has one row per day).  Model
fitting is sequential within a series, so each series is fitted inside
``groupBy(key).applyInPandas`` with numpy — all series in parallel.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scalars import date_features, is_holiday, season_weather

# ---------------------------------------------------------------- pure numpy helpers (per series)


def holt(y: np.ndarray, alpha: float, beta: float):
    """Additive-trend Holt recursion → (one-step fitted values, last level,
    last trend)."""
    level, trend = y[0], (y[1] - y[0]) if len(y) > 1 else 0.0
    fitted = np.empty(len(y))
    fitted[0] = y[0]
    for t in range(1, len(y)):
        fitted[t] = level + trend
        new_level = alpha * y[t] + (1 - alpha) * (level + trend)
        trend = beta * (new_level - level) + (1 - beta) * trend
        level = new_level
    return fitted, level, trend


def holt_winters(y: np.ndarray, alpha: float, beta: float, gamma: float, m: int):
    """Additive Holt–Winters with period m."""
    n = len(y)
    level = y[:m].mean()
    trend = (y[m:2 * m].mean() - y[:m].mean()) / m if n >= 2 * m else 0.0
    season = list(y[:m] - level)
    fitted = np.empty(n)
    fitted[:m] = y[:m]
    for t in range(m, n):
        s = season[t - m]
        fitted[t] = level + trend + s
        new_level = alpha * (y[t] - s) + (1 - alpha) * (level + trend)
        trend = beta * (new_level - level) + (1 - beta) * trend
        season.append(gamma * (y[t] - new_level) + (1 - gamma) * s)
        level = new_level
    return fitted, level, trend, season


def adf_tstat(y: np.ndarray, max_lag: int | None = None) -> float:
    """Augmented Dickey–Fuller t statistic (constant, lags chosen by AIC)."""
    y = np.asarray(y, float)
    n = len(y)
    if n < 8:
        return float("nan")
    dy = np.diff(y)
    max_lag = max_lag if max_lag is not None else int(min(12 * (n / 100) ** 0.25, n // 3 - 2))
    max_lag = max(max_lag, 0)

    def regress(p, skip):
        """t statistic and AIC with p lags over the rows from ``skip`` on."""
        rows = len(dy) - skip
        X = [np.ones(rows), y[skip:-1]]
        for k in range(1, p + 1):
            X.append(dy[skip - k:len(dy) - k])
        X = np.column_stack(X)
        target = dy[skip:]
        coef, *_ = np.linalg.lstsq(X, target, rcond=None)
        resid = target - X @ coef
        sigma2 = resid @ resid / max(rows - X.shape[1], 1)
        cov = sigma2 * np.linalg.pinv(X.T @ X)
        t = coef[1] / math.sqrt(cov[1, 1]) if cov[1, 1] > 0 else float("nan")
        return t, rows * math.log(max(resid @ resid / rows, 1e-300)) + 2 * X.shape[1]

    while max_lag and len(dy) - max_lag <= max_lag + 3:
        max_lag -= 1
    # lag orders are compared over the same rows, the chosen one is fitted on all of its own
    best = min(range(max_lag + 1), key=lambda p: regress(p, max_lag)[1])
    return float(regress(best, best)[0])


def adf_critical(n: int) -> float:
    """5 % critical value with a constant for n points (MacKinnon's response surface)."""
    return -2.8621 - 2.738 / n - 8.36 / n ** 2


def arima_residuals(zc: np.ndarray, p: int, q: int, coef: np.ndarray) -> np.ndarray:
    """One-step residuals of a centred series under given AR and MA
    coefficients (conditional: values and residuals before the start are 0)."""
    e = np.zeros(len(zc))
    for t in range(len(zc)):
        ar = sum(coef[k] * zc[t - 1 - k] for k in range(min(p, t)))
        ma = sum(coef[p + k] * e[t - 1 - k] for k in range(min(q, t)))
        e[t] = zc[t] - ar - ma
    return e


def arima_css(y: np.ndarray, p: int, d: int, q: int):
    """ARIMA(p, d, q) by Hannan–Rissanen: a long AR fit gives residual
    estimates, then one least-squares fit of y on its lags and lagged
    residuals.  The model's own residuals then follow by recursion, and both
    the fitted values and forecasts rest on them.  Returns (fitted on the
    original scale, aic, coefficients, mean)."""
    z = np.diff(y, n=d) if d else y.astype(float)
    n = len(z)
    mu = z.mean()
    zc = z - mu
    m = max(p + q + 2, min(10, n // 4))
    e = np.zeros(n)
    if q > 0 and n > m + 2:
        X = np.column_stack([zc[m - k:n - k] for k in range(1, m + 1)])
        a, *_ = np.linalg.lstsq(X, zc[m:], rcond=None)
        e[m:] = zc[m:] - X @ a
    start = max(p, q, 1)
    cols = [zc[start - k:n - k] for k in range(1, p + 1)] + [e[start - k:n - k] for k in range(1, q + 1)]
    coef = np.linalg.lstsq(np.column_stack(cols), zc[start:], rcond=None)[0] if cols else np.array([])
    ma = coef[p:]
    if len(ma) and np.abs(np.roots(np.concatenate([[1.0], ma]))).max(initial=0) >= 1:
        raise np.linalg.LinAlgError("the MA part is not invertible")
    resid = arima_residuals(zc, p, q, coef)
    # every order is scored on the same rows
    used = resid[min(3, n - 1):]
    aic = len(used) * math.log(max(float(used @ used) / len(used), 1e-300)) + 2 * (p + q + 1)
    fitted_z = z - resid
    fitted = np.concatenate([y[:1], y[:-1] + fitted_z]) if d == 1 else fitted_z
    return fitted, aic, coef, mu


def arima_forecast(y: np.ndarray, p: int, d: int, q: int, coef, mu, h: int) -> np.ndarray:
    z = list((np.diff(y, n=d) if d else y.astype(float)) - mu)
    e = list(arima_residuals(np.array(z), p, q, coef))
    out = []
    for _ in range(h):
        ar = sum(coef[k] * z[-1 - k] for k in range(p)) if p else 0.0
        ma = sum(coef[p + k] * e[-1 - k] for k in range(q)) if q else 0.0
        nxt = ar + ma
        z.append(nxt)
        e.append(0.0)
        out.append(nxt + mu)
    out = np.array(out)
    return np.cumsum(out) + y[-1] if d == 1 else out


# ---------------------------------------------------------------- grouped fits

FIT_SCHEMA = ("series string, model string, params string, mae double, rmse double, r2 double, "
              "stationary boolean, seasonal boolean")
FORECAST_SCHEMA = "series string, model string, step int, forecast double"


def _metrics(y, f):
    err = y - f
    sst = ((y - y.mean()) ** 2).sum()
    return float(np.abs(err).mean()), float(math.sqrt((err ** 2).mean())), \
        float(1 - (err ** 2).sum() / sst) if sst > 0 else float("nan")


def _acf(y, lag):
    yc = y - y.mean()
    den = (yc ** 2).sum()
    return float((yc[lag:] * yc[:-lag]).sum() / den) if den > 0 and lag < len(y) else 0.0


def _best_arima(y, d, orders):
    """(aic, p, q, fitted, coefficients, mean) with the least AIC, or None."""
    best = None
    for p, q in orders:
        try:
            fit = arima_css(y, p, d, q)
        except np.linalg.LinAlgError:
            continue
        if best is None or fit[1] < best[0]:
            best = (fit[1], p, q, fit[0], fit[2], fit[3])
    return best


def fit_series(pdf: pd.DataFrame, horizon: int | None):
    """All candidate models of one series → (fit rows, forecast rows).

    Series of 24 points and more are tested for seasonality (period 12) and
    get a ``sarimax`` model: on the seasonally differenced series if seasonal,
    a small ARIMA otherwise.  Exponential smoothing is Holt–Winters for a
    seasonal series and Holt for others.  All models of a series are scored
    on one span, the points that every model predicts.  Without a horizon it
    is a third of the points, 30 at most."""
    pdf = pdf.sort_values("t")
    key = str(pdf["series"].iloc[0])
    y = pdf["y"].to_numpy(float)
    n = len(y)
    horizon = min(30, n // 3) if horizon is None else horizon
    seasonal = n >= 24 and any(_acf(y, L) > 0.3 for L in (7, 12, 24) if L <= min(24, n // 3))
    span = 12 if seasonal else 1
    tstat = adf_tstat(y)
    stationary = bool(tstat < adf_critical(n)) if not math.isnan(tstat) else False
    fits, fcs = [], []

    def keep(model, params, fitted, forecast):
        fits.append((key, model, params, *_metrics(y[span:], fitted[span:]), stationary, seasonal))
        fcs.extend((key, model, h + 1, float(v)) for h, v in enumerate(forecast))

    grid = [0.1, 0.3, 0.5, 0.7, 0.9]
    if n >= 3:
        runs = [(a, b, *holt(y, a, b)) for a, b in itertools.product(grid, grid)]
        a, b, f, lv, tr = min(runs, key=lambda r: float(((y[1:] - r[2][1:]) ** 2).sum()))
        keep("holt", f"alpha={a},beta={b}", f, [lv + h * tr for h in range(1, horizon + 1)])
    if seasonal:
        runs = [(a, b, g, *holt_winters(y, a, b, g, 12)) for a, b, g in itertools.product(grid, [0.1, 0.3], [0.1, 0.3])]
        a, b, g, f, lv, tr, s = min(runs, key=lambda r: float(((y[12:] - r[3][12:]) ** 2).sum()))
        keep("holt_winters", f"alpha={a},beta={b},gamma={g}", f,
             [lv + h * tr + s[len(s) - 12 + (h - 1) % 12] for h in range(1, horizon + 1)])
    d = 0 if stationary else 1
    small = list(itertools.product(range(2), range(2)))
    if seasonal:
        # period-12 differences (D = 1); forecasts are integrated back with the seasonal lag
        best = _best_arima(y[12:] - y[:-12], 0, small)
        if best is not None:
            _, p, q, f, coef, mu = best
            hist = list(y)
            for step in arima_forecast(y[12:] - y[:-12], p, 0, q, coef, mu, horizon):
                hist.append(float(step + hist[-12]))
            keep("sarimax", f"p={p},q={q},D=1,s=12", np.concatenate([y[:12], f + y[:-12]]), hist[n:])
    elif n >= 24:
        best = _best_arima(y, d, small)
        if best is not None:
            _, p, q, f, coef, mu = best
            keep("sarimax", f"p={p},d={d},q={q}", f, arima_forecast(y, p, d, q, coef, mu, horizon))
    if n >= 10:
        best = _best_arima(y, d, itertools.product(range(3), range(3)))
        if best is not None:
            _, p, q, f, coef, mu = best
            keep("arima", f"p={p},d={d},q={q}", f, arima_forecast(y, p, d, q, coef, mu, horizon))
    return fits, fcs


def fit_models(series: DataFrame, key: str, order_col: str, value_col: str, horizon: int | None = None) -> DataFrame:
    """Per series: every candidate model's in-sample MAE / RMSE / R² plus
    its forecast, in one grouped pass (output rows carry a kind tag)."""
    x = series.select(F.col(key).cast("string").alias("series"), F.col(order_col).alias("t"),
                      F.col(value_col).cast("double").alias("y"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fits, fcs = fit_series(pdf, horizon)
        names = ["kind", "series", "model", "params", "mae", "rmse", "r2", "stationary", "seasonal", "step", "forecast"]
        rows = [("fit", *f, None, None) for f in fits]
        rows += [("forecast", k, m, None, None, None, None, None, None, h, v) for k, m, h, v in fcs]
        return pd.DataFrame(rows, columns=names)

    schema = ("kind string, series string, model string, params string, mae double, rmse double, r2 double, "
              "stationary boolean, seasonal boolean, step int, forecast double")
    return x.groupBy("series").applyInPandas(run, schema)


def select_best(fits: DataFrame) -> DataFrame:
    """Per series the model with the lowest MAE (ties by model name)."""
    f = fits.filter(F.col("kind") == "fit")
    return f.groupBy("series").agg(F.min_by("model", F.struct("mae", "model")).alias("best_model"),
                                   F.min("mae").alias("best_mae"))


# ---------------------------------------------------------------- demand features / spine


def demand_features(df: DataFrame, date_col: str) -> DataFrame:
    feats = {k: v.cast("double") for k, v in date_features(date_col).items()}
    return df.withColumns(feats).withColumn("weather_code", season_weather(date_col).cast("double")) \
             .withColumn("holiday", is_holiday(date_col).cast("double"))


def forecast_spine(keys: DataFrame, key: str, start_col: str, days: int) -> DataFrame:
    """keys × next ``days`` dates as a generated column (no join)."""
    return keys.select(key, F.explode(F.sequence(F.date_add(F.col(start_col), 1),
                                                 F.date_add(F.col(start_col), days))).alias("date"))


def tree_interval(model, df: DataFrame, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """5 / 95 % interval over the individual trees of a fitted forest (exact
    linear percentile of the per-tree predictions)."""
    x = model.transform(df, each_tree=True).withColumn("tree_values", F.array_sort("tree_values"))

    def pct(p):
        pos = F.lit(p) * (F.size("tree_values") - 1)
        low, high = (F.get("tree_values", f(pos).cast("int")) for f in (F.floor, F.ceil))
        return low + (high - low) * (pos - F.floor(pos))

    return x.withColumn("lower", pct(lo)).withColumn("upper", pct(hi)).drop("tree_values")
