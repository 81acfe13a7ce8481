"""Fitted series as a table, and forecasts from it without fitting again.

A series' row holds its terms, its error deviation and the last ``season + 1`` values,
differences and errors; that is all a forecast of any range needs. Forecasting is a fold
over the steps ahead inside the JVM, row by row: no Python, no group, no shuffle. New days
move a row forward by the same recursion, so the terms are kept while the tail follows the
sales. Days inside the history have their one-step predictions in ``past``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.operators.forecast import SEASON, fit_series, one_step_fit, project
from demandlens.operators.yardstick import Z_VALUES

STATE = (
    "season int, last_date date, method string, ar array<double>, ma array<double>, sigma double, bound double, "
    "y array<double>, w array<double>, e array<double>, past array<struct<date: date, mean: double>>"
)
#: Steps for which a fit is tried; one that runs away within them is replaced by the last season.
TRIED = 366


def series_rows(daily: DataFrame, by: Sequence[str], measure: str) -> DataFrame:
    """One row per series with its gap-free days in order; its size is that of the calendar."""
    day = F.struct("date", F.col(measure).cast("double").alias("y"))
    return daily.groupBy(*by).agg(F.sort_array(F.collect_list(day)).alias("days")).filter(F.size("days") > 0)


def _fitted(days: list, season: int) -> dict:
    y = np.array([d["y"] for d in days], float)
    dates = [d["date"] for d in days]
    fit = fit_series(y, season)
    if fit is not None and project(y, fit, TRIED, season) is None:
        fit = None
    keep = season + 1
    if fit is not None:
        past = one_step_fit(y, fit, season)
        terms = {"method": "sarima", "ar": fit["ar"].tolist(), "ma": fit["ma"].tolist(), "sigma": fit["sigma"]}
        tails = {"w": fit["w"][-keep:].tolist(), "e": fit["errors"][-keep:].tolist()}
    else:
        gaps = y[season:] - y[:-season]
        past = np.concatenate([np.full(min(season, len(y)), np.nan), y[:-season]])
        terms = {"method": "seasonal_naive", "ar": None, "ma": None, "sigma": float(np.std(gaps)) if len(gaps) else 0.0}
        tails = {"w": None, "e": None}
    told = [(d, float(m)) for d, m in zip(dates, past) if np.isfinite(m)]
    bound = 10 * (float(np.abs(y).max()) + 1)
    return {"season": season, "last_date": dates[-1], **terms, "bound": bound, "y": y[-keep:].tolist(), **tails, "past": told}


def fit_store(daily: DataFrame, by: Sequence[str] = (), measure: str = "revenue", season: int = SEASON) -> DataFrame:
    """Fitted state of every series: (by..., season, last_date, terms, tails, past)."""
    names = [c.split()[0] for c in STATE.replace("<date: date, mean: double>", "").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_fitted(list(days), season) for days in batch["days"]]
            out = batch[list(by)].reset_index(drop=True)
            for name in names:
                out[name] = pd.Series([f[name] for f in found], dtype=object)
            yield out

    rows = series_rows(daily, by, measure)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema] if by else []
    return rows.mapInPandas(run, ", ".join([*fields, STATE]))


def store_with_terms(
    daily: DataFrame, ar: Sequence[float], ma: Sequence[float], sigma: float, by: Sequence[str] = (), measure: str = "revenue", season: int = SEASON
) -> DataFrame:
    """A store with given terms (lags 1, season, season + 1), moved over the whole history.

    Series of at most ``2 * season + 2`` days are left out: their tail is not known.
    """
    first, keep = 2 * season + 2, season + 1
    rows = series_rows(daily, by, measure).filter(F.size("days") > first)
    y = F.transform("days", lambda d: d["y"])
    w = F.transform(
        F.sequence(F.lit(keep), F.lit(first - 1)),
        lambda i: F.get("_y", i) - F.get("_y", i - 1) - F.get("_y", i - season) + F.get("_y", i - keep),
    )
    rows = rows.withColumn("_y", y)
    state = rows.select(
        *by,
        F.lit(season).alias("season"),
        F.get("days", F.lit(first - 1))["date"].alias("last_date"),
        F.lit("sarima").alias("method"),
        F.array(*map(F.lit, map(float, ar))).alias("ar"),
        F.array(*map(F.lit, map(float, ma))).alias("ma"),
        F.lit(float(sigma)).alias("sigma"),
        (10 * (F.array_max(F.transform("_y", F.abs)) + 1)).alias("bound"),
        F.slice("_y", keep + 1, keep).alias("y"),
        w.alias("w"),
        F.array_repeat(F.lit(0.0), keep).alias("e"),
        F.array().cast("array<struct<date: date, mean: double>>").alias("past"),
        F.slice("days", first + 1, F.size("days")).alias("days"),
    )
    return _moved(state)


def _push(tail: Column, value: Column) -> Column:
    return F.concat(F.slice(tail, 2, F.size(tail)), F.array(value))


def _expected(acc: Column, ar: Column, ma: Column, season: Column) -> Column:
    """The next difference as the terms see it; tails are in order, so the last value is at ``season``."""
    at = (season, F.lit(1), F.lit(0))
    terms = [F.get(ar, F.lit(i)) * F.get(acc["w"], k) + F.get(ma, F.lit(i)) * F.get(acc["e"], k) for i, k in enumerate(at)]
    return terms[0] + terms[1] + terms[2]


def _level(y: Column, season: Column) -> Column:
    return F.get(y, season) + F.get(y, F.lit(1)) - F.get(y, F.lit(0))


def _moved(state: DataFrame) -> DataFrame:
    """The state after its ``days`` (later than ``last_date``, gap-free, in order)."""
    season, ar, ma = F.col("season"), F.col("ar"), F.col("ma")

    def model(acc: Column, day: Column) -> Column:
        level, expected = _level(acc["y"], season), _expected(acc, ar, ma, season)
        w = day["y"] - level
        mean = F.struct(day["date"].alias("date"), (level + expected).alias("mean"))
        return F.struct(
            _push(acc["y"], day["y"]).alias("y"),
            _push(acc["w"], w).alias("w"),
            _push(acc["e"], w - expected).alias("e"),
            F.concat(acc["past"], F.array(mean)).alias("past"),
        )

    def naive(acc: Column, day: Column) -> Column:
        # The tail has one value more than a season once it is full.
        kept = F.concat(acc["y"], F.array(day["y"]))
        before = F.get(acc["y"], F.size(acc["y"]) - season)
        told = F.array(F.struct(day["date"].alias("date"), before.alias("mean")))
        return F.struct(
            F.when(F.size(kept) > season + 1, F.slice(kept, 2, F.size(kept))).otherwise(kept).alias("y"),
            acc["w"].alias("w"),
            acc["e"].alias("e"),
            F.when(F.size(acc["y"]) >= season, F.concat(acc["past"], told)).otherwise(acc["past"]).alias("past"),
        )

    start = F.struct("y", "w", "e", "past")
    after = F.when(F.col("method") == "sarima", F.aggregate("days", start, model)).otherwise(F.aggregate("days", start, naive))
    last = F.coalesce(F.try_element_at("days", F.lit(-1))["date"], F.col("last_date"))
    out = state.withColumn("_after", after).withColumn("last_date", last)
    return out.withColumns({c: F.col(f"_after.{c}") for c in ("y", "w", "e", "past")}).drop("_after", "days")


def advance(store: DataFrame, daily: DataFrame, by: Sequence[str] = (), measure: str = "revenue") -> DataFrame:
    """The store moved over the days of ``daily`` after each series' last one; its terms stay."""
    later = series_rows(daily, by, measure)
    if by:
        joined = store.join(later, list(by), "left")
    else:
        joined = store.withColumn("days", later.select("days").scalar())  # one series, one row
    days = F.coalesce("days", F.array().cast("array<struct<date: date, y: double>>"))
    return _moved(joined.withColumn("days", F.filter(days, lambda d: d["date"] > F.col("last_date"))))


def forecast_from_store(
    store: DataFrame, start: dt.date, end: dt.date, by: Sequence[str] = (), level: float = 0.95
) -> DataFrame:
    """(by..., date, predicted_revenue, lower, upper, method) for start..end of every series in the store.

    A forecast that leaves ``bound`` or is not finite is replaced by the last season. Nothing is negative.
    """
    if start > end:
        raise ValueError("start date must not be after end date")
    z = Z_VALUES[level]
    season, ar, ma, keep = F.col("season"), F.col("ar"), F.col("ma"), F.col("season") + 1
    ahead = F.datediff(F.lit(end), "last_date")
    steps = F.when(ahead > 0, F.sequence(F.lit(1), ahead)).otherwise(F.array().cast("array<int>"))

    def fold(y: Column, w: Column, e: Column, shock: float) -> Column:
        def step(acc: Column, h: Column) -> Column:
            new = F.when(h == 1, F.lit(shock)).otherwise(F.lit(0.0))
            w = _expected(acc, ar, ma, season) + new
            value = w + _level(acc["y"], season)
            return F.struct(
                _push(acc["y"], value).alias("y"),
                _push(acc["w"], w).alias("w"),
                _push(acc["e"], new).alias("e"),
                F.concat(acc["out"], F.array(value)).alias("out"),
            )

        begin = F.struct(y.alias("y"), w.alias("w"), e.alias("e"), F.array().cast("array<double>").alias("out"))
        return F.aggregate(steps, begin, step, lambda acc: acc["out"])

    zeros = F.array_repeat(F.lit(0.0), keep)
    mean = fold(F.col("y"), F.col("w"), F.col("e"), 0.0)
    response = fold(zeros, zeros, zeros, 1.0)
    spread = F.aggregate(
        F.col("_response"),
        F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("out")),
        lambda acc, r: F.struct(
            (acc["sum"] + r * r).alias("sum"), F.concat(acc["out"], F.array(F.col("sigma") * F.sqrt(acc["sum"] + r * r))).alias("out")
        ),
        lambda acc: acc["out"],
    )
    tail = F.slice("y", F.greatest(F.size("y") - season, F.lit(0)) + 1, season)
    again = F.transform(steps, lambda h: F.get(tail, (h - 1) % F.size(tail)))
    wide = F.transform(steps, lambda h: F.col("sigma") * F.sqrt(1 + F.floor((h - 1) / season)))
    wild = lambda v, most: v.isNull() | F.isnan(v) | (F.abs(v) >= most)
    model = F.col("method") == "sarima"
    out = store.withColumn("_mean", F.when(model, mean)).withColumn("_response", F.when(model, response))
    out = out.withColumn("_spread", F.when(model, spread))
    away = F.exists("_mean", lambda v: wild(v, F.col("bound"))) | F.exists("_spread", lambda v: wild(v, F.lit(float("inf"))))
    out = out.withColumn("_method", F.when(model & ~away, "sarima").otherwise("seasonal_naive"))
    good = F.col("_method") == "sarima"
    out = out.withColumns({"_mean": F.when(good, F.col("_mean")).otherwise(again), "_spread": F.when(good, F.col("_spread")).otherwise(wide)})
    future = F.transform(
        F.arrays_zip(steps.alias("h"), F.col("_mean"), F.col("_spread")),
        lambda x: F.struct(F.date_add("last_date", x["h"]).alias("date"), x["_mean"].alias("mean"), x["_spread"].alias("sd"), F.col("_method").alias("method")),
    )
    past = F.transform("past", lambda x: F.struct(x["date"].alias("date"), x["mean"].alias("mean"), F.col("sigma").alias("sd"), F.col("method").alias("method")))
    rows = out.select(*by, F.explode(F.filter(F.concat(past, future), lambda x: x["date"].between(F.lit(start), F.lit(end)))).alias("x"))
    at_least_0 = lambda v: F.greatest(v, F.lit(0.0))
    m, sd = F.col("x.mean"), F.col("x.sd")
    return rows.select(
        *by,
        F.col("x.date").alias("date"),
        at_least_0(m).alias("predicted_revenue"),
        at_least_0(m - z * sd).alias("lower"),
        at_least_0(m + z * sd).alias("upper"),
        F.col("x.method").alias("method"),
    )


def save_store(store: DataFrame, path: str) -> None:
    store.write.mode("overwrite").parquet(path)
