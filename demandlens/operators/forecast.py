"""Seasonal ARIMA forecasts for many daily series at once.

Sales are first summed to one row per day and series, so a series is as long as its
calendar, however many sales it has; the series are then fitted in parallel. The model is
(1,1,1)(1,1,1) over the season: each series is differenced once and once over the season;
the autoregressive and moving-average terms start from two least-squares stages (Hannan
and Rissanen, 1982) and are refined on the conditional sum of squares. A series that is
too short, constant or unstable repeats its last season and says so in ``method``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.operators.yardstick import Z_VALUES

SEASON = 7


BOUND = 0.97  # keeps the fitted terms stationary and invertible


def _lagged(x: np.ndarray, lags: Sequence[int], start: int) -> np.ndarray:
    return np.column_stack([x[start - k : len(x) - k] for k in lags])


def _one_step_errors(w: np.ndarray, terms: np.ndarray, season: int) -> np.ndarray:
    """Errors of the multiplicative model with terms (ar, seasonal ar, ma, seasonal ma)."""
    ar, seasonal_ar, ma, seasonal_ma = terms
    x = w.copy()
    x[1:] -= ar * w[:-1]
    x[season:] -= seasonal_ar * x[:-season].copy()
    u = np.fromiter(accumulate(x, lambda e, v: v - ma * e), float, len(x))
    rows = np.resize(np.append(u, np.zeros(-len(u) % season)), (-(-len(u) // season), season))
    for i in range(1, len(rows)):
        rows[i] -= seasonal_ma * rows[i - 1]
    return rows.ravel()[: len(u)]


def fit_series(y: np.ndarray, season: int = SEASON, rounds: int = 20) -> dict | None:
    """Terms, past errors and error deviation, or None when the series cannot be fitted."""
    if len(y) < 6 * season + 12:
        return None
    w = (y[1:] - y[:-1])[season:] - (y[1:] - y[:-1])[:-season]
    if np.ptp(w) == 0:
        return None
    scale = np.std(w)
    x = w / scale
    # Starting values: a long autoregression gives errors, a second regression the terms.
    long = 2 * season
    first, *_ = np.linalg.lstsq(_lagged(x, range(1, long + 1), long), x[long:], rcond=None)
    rough = np.zeros_like(x)
    rough[long:] = x[long:] - _lagged(x, range(1, long + 1), long) @ first
    start, both = long + season, (1, season)
    second, *_ = np.linalg.lstsq(
        np.hstack([_lagged(x, both, start), _lagged(rough, both, start)]), x[start:], rcond=None
    )
    terms = np.clip(second, -BOUND, BOUND)
    # Damped Gauss-Newton steps on the sum of squared one-step errors.
    errors = _one_step_errors(x, terms, season)
    for _ in range(rounds):
        nudged = [_one_step_errors(x, terms + 1e-4 * np.eye(4)[k], season) for k in range(4)]
        slope = (np.column_stack(nudged) - errors[:, None]) / 1e-4
        step, *_ = np.linalg.lstsq(slope, -errors, rcond=None)
        best, size = errors @ errors, 1.0
        while size > 1e-3:
            candidate = np.clip(terms + size * step, -BOUND, BOUND)
            tried = _one_step_errors(x, candidate, season)
            if tried @ tried < best:
                break
            size /= 2
        else:
            break
        gain = best - tried @ tried
        terms, errors = candidate, tried
        if gain < 1e-6 * best:
            break
    ar, seasonal_ar, ma, seasonal_ma = terms
    return {
        "ar": np.array([ar, seasonal_ar, -ar * seasonal_ar]),
        "ma": np.array([ma, seasonal_ma, ma * seasonal_ma]),
        "w": w,
        "errors": errors * scale,
        "sigma": float(np.std(errors[season + 1 :]) * scale),
    }


def project(y: np.ndarray, fit: dict, horizon: int, season: int = SEASON) -> tuple[np.ndarray, np.ndarray] | None:
    """Forecast and its standard error for each step ahead, or None when it runs away."""
    lags = [1, season, season + 1]

    def run(values, w, errors, shock: float) -> np.ndarray:
        values, w, errors = list(values), list(w), list(errors)
        n = len(values)
        for h in range(horizon):
            new = shock if h == 0 else 0.0
            step = fit["ar"] @ [w[-k] for k in lags] + fit["ma"] @ [errors[-k] for k in lags] + new
            w.append(step)
            errors.append(new)
            values.append(step + values[-1] + values[-season] - values[-season - 1])
        return np.array(values[n:])

    zeros = np.zeros(season + 1)
    with np.errstate(all="ignore"):
        mean = run(y, fit["w"], fit["errors"], 0.0)
        response = run(zeros, zeros, zeros, 1.0)
        spread = fit["sigma"] * np.sqrt(np.cumsum(response**2))
    limit = 10 * (np.abs(y).max() + 1)
    if not np.all(np.isfinite(spread)) or not np.all(np.abs(mean) < limit):
        return None
    return mean, spread


def one_step_fit(y: np.ndarray, fit: dict, season: int = SEASON) -> np.ndarray:
    """Prediction of every day from the days before it (the first season has none)."""
    out = np.full(len(y), np.nan)
    out[season + 1 :] = y[season + 1 :] - fit["errors"]
    out[: 2 * season + 2] = np.nan
    return out


def forecast_range(
    daily: DataFrame,
    start: dt.date,
    end: dt.date,
    by: Sequence[str] = (),
    measure: str = "revenue",
    season: int = SEASON,
    level: float = 0.95,
) -> DataFrame:
    """Predictions for start..end of every series: (by..., date, predicted_revenue, lower, upper, method).

    ``daily`` is gap-free (see ``buckets.daily_series``). Days inside the history get the
    one-step prediction, later days the forecast from the end of the series. Nothing is
    negative. An empty range gives no rows; a start after the end is an error.
    """
    if start > end:
        raise ValueError("start date must not be after end date")
    keys = list(by)
    if not keys:
        # A single series is one row of a store, not a group of rows.
        from demandlens.operators import forecast_store

        return forecast_store.forecast_from_store(forecast_store.fit_store(daily, (), measure, season), start, end, (), level)
    z = Z_VALUES[level]

    def per_series(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        y = pdf["y"].to_numpy(dtype=float)
        days = pd.to_datetime(pdf["date"]).to_numpy()
        last = pd.Timestamp(days[-1])
        horizon = max((pd.Timestamp(end) - last).days, 0)
        fit = fit_series(y, season)
        ahead = project(y, fit, horizon, season) if fit is not None else None
        if fit is not None and ahead is None:
            fit = None
        if fit is not None:
            method, past, (future, spread) = "sarima", one_step_fit(y, fit, season), ahead
            past_spread = np.full(len(y), fit["sigma"])
        else:
            method = "seasonal_naive"
            tail = y[-season:] if len(y) >= season else y
            future = np.resize(tail, horizon)
            past = np.concatenate([np.full(min(season, len(y)), np.nan), y[:-season]])
            gaps = y[season:] - y[:-season]
            sigma = float(np.std(gaps)) if len(gaps) else 0.0
            spread = sigma * np.sqrt(1 + np.arange(horizon) // season)
            past_spread = np.full(len(y), sigma)
        ahead_days = last + pd.to_timedelta(np.arange(1, horizon + 1), unit="D")
        out = pd.DataFrame(
            {
                "date": np.concatenate([days.astype("datetime64[ns]"), ahead_days.to_numpy().astype("datetime64[ns]")]),
                "mean": np.concatenate([past, future]),
                "sd": np.concatenate([past_spread, spread]),
            }
        )
        out = out[(out["date"] >= pd.Timestamp(start)) & (out["date"] <= pd.Timestamp(end)) & out["mean"].notna()]
        if out.empty:
            return pd.DataFrame()
        result = pd.DataFrame({k: [pdf[k].iloc[0]] * len(out) for k in keys})
        result["date"] = out["date"].dt.date.to_numpy()
        result["predicted_revenue"] = np.maximum(out["mean"].to_numpy(), 0.0)
        result["lower"] = np.maximum(out["mean"].to_numpy() - z * out["sd"].to_numpy(), 0.0)
        result["upper"] = np.maximum(out["mean"].to_numpy() + z * out["sd"].to_numpy(), 0.0)
        result["method"] = method
        return result

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in daily.select(*keys).schema]
    schema = ", ".join(
        [*fields, "date date", "predicted_revenue double", "lower double", "upper double", "method string"]
    )
    series = daily.select(*keys, "date", F.col(measure).alias("y"))
    return series.groupBy(*keys).applyInPandas(per_series, schema)
