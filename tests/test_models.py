"""Models, forecasts and attribution: bounds and invariants."""

import datetime as dt
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from demandlens.operators import attribution, forecast, trees
from demandlens.plans import scoring
from pyspark.sql import functions as F

D = dt.date


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = 3 * x[:, 0] + np.where(x[:, 1] > 0, 2.0, -2.0) + 0.1 * rng.normal(size=2000)
    rows = [(i + 1, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "rn bigint, a double, b double, c double, d double, y double")
    return trees.assemble(df, ["a", "b", "c", "d"], "y").persist()


@pytest.fixture(scope="module")
def models(data):
    return {
        "forest": trees.random_forest(trees=8, depth=5).fit(data),
        "boosting": trees.gradient_boosting(rounds=8, depth=3).fit(data),
    }


@pytest.mark.parametrize("name", ["forest", "boosting"])
def test_models_beat_the_mean(data, models, name):
    scored = models[name].transform(data)
    mean = data.agg(F.avg("label")).first()[0]
    row = scored.agg(F.avg(F.abs(F.col("label") - F.col("prediction"))), F.avg(F.abs(F.col("label") - mean))).first()
    assert row[0] < 0.5 * row[1]


def test_importance_names_the_drivers(spark, models):
    rows = trees.feature_importance(models["forest"], ["a", "b", "c", "d"], spark).collect()
    assert {rows[0]["feature"], rows[1]["feature"]} == {"a", "b"}
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0)


@pytest.mark.parametrize("name", ["forest", "boosting"])
def test_attribution_sums_to_prediction(spark, data, models, name, tmp_path):
    path = str(tmp_path / name)
    models[name].save(path)
    long = attribution.attribute(data, path, ["a", "b", "c", "d"], ["rn"], attribution.ensemble_weights(models[name]))
    sums = long.groupBy("rn", "base_value").agg(F.sum("contribution").alias("s"), F.count("*").alias("n"))
    joined = models[name].transform(data).join(sums, "rn")
    worst = joined.agg(F.max(F.abs(F.col("prediction") - F.col("base_value") - F.col("s"))), F.count("*"), F.max("n"))
    assert worst.first()[0] < 1e-9
    assert worst.first()[1:] == (2000, 4)


def test_attribution_against_all_subsets(spark, data, models, tmp_path):
    """Brute force over every coalition, from the definition."""
    path = str(tmp_path / "forest")
    models["forest"].save(path)
    nodes = attribution.tree_nodes(spark, path).toPandas()
    weights = attribution.ensemble_weights(models["forest"])
    x = np.array(data.limit(5).select("a", "b", "c", "d").collect())
    base, phi = attribution.contributions(x, attribution.leaves(nodes, weights))

    def expected(tree, row, known, i=0):
        n = tree[i]
        if n.left < 0:
            return n.value
        if n.feature in known:
            return expected(tree, row, known, n.left if row[n.feature] <= n.threshold else n.right)
        left, right = tree[n.left], tree[n.right]
        parts = [c.cover / n.cover * expected(tree, row, known, c.id) for c in (left, right)]
        return sum(parts)

    forest = {t: {r.id: r for r in part.itertuples()} for t, part in nodes.groupby("tree")}
    value = lambda row, known: sum(weights[t] * expected(tree, row, known) for t, tree in forest.items())
    for r, row in enumerate(x):
        assert base == pytest.approx(value(row, set()))
        for j in range(4):
            others = [k for k in range(4) if k != j]
            total = 0.0
            for size in range(4):
                for s in combinations(others, size):
                    w = factorial(size) * factorial(3 - size) / factorial(4)
                    total += w * (value(row, {*s, j}) - value(row, set(s)))
            assert phi[r, j] == pytest.approx(total)


def test_grid_search_finds_the_deeper_tree(data):
    summary, best = trees.grid_search(data, 2000, {"trees": [4], "depth": [1, 5]}, parallelism=2)
    rows = {r["depth"]: r["mean_mae"] for r in summary.collect()}
    assert best == {"trees": 4, "depth": 5}
    assert rows[5] < rows[1]
    assert all(r["folds"] == 3 for r in summary.collect())


def test_grid_search_fits_depths_once(data, monkeypatch):
    """Points of one fold that differ in depth alone share a fit, with the errors of forests of their own."""
    grid, fits = {"trees": [3], "depth": [2, 6, 4]}, []
    plain = trees.random_forest
    monkeypatch.setattr(trees, "random_forest", lambda **point: fits.append(point) or plain(**point))
    summary, best = trees.grid_search(data, 2000, grid, splits=2)
    assert sorted((p["trees"], p["depth"]) for p in fits) == [(3, 6), (3, 6)]
    found = {(r["trees"], r["depth"]): r["mean_mae"] for r in summary.collect()}
    own = {}
    for n, d in found:
        errors = []
        for fold in range(2):
            train, test = trees.fold_filter(fold, 2000, 2)
            out = plain(trees=n, depth=d).fit(data.filter(train)).transform(data.filter(test))
            errors.append(out.agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0])
        own[n, d] = sum(errors) / 2
    assert found == pytest.approx(own, rel=1e-9)
    assert (best["trees"], best["depth"]) == min(own, key=own.get)


# --- forecasts -------------------------------------------------------------------------


def series(n, noise=1.0, seed=0):
    t = np.arange(n)
    rng = np.random.default_rng(seed)
    return 100 + 0.1 * t + 10 * np.sin(2 * np.pi * t / 7) + noise * rng.normal(size=n)


def test_fit_recovers_trend_and_season():
    y = series(735)
    fit = forecast.fit_series(y[:700])
    mean, spread = forecast.project(y[:700], fit, 35)
    naive = np.resize(y[693:700], 35)
    assert np.abs(mean - y[700:]).mean() < 1.2
    assert np.abs(mean - y[700:]).mean() < np.abs(naive - y[700:]).mean()
    assert np.all(np.diff(spread) > 0)


def test_errors_follow_the_model_definition():
    y = series(300)
    fit = forecast.fit_series(y)
    w, lags, want = fit["w"], (1, 7, 8), []
    for t in range(len(w)):
        e = w[t] - sum(a * w[t - k] for a, k in zip(fit["ar"], lags) if t >= k)
        want.append(e - sum(m * want[t - k] for m, k in zip(fit["ma"], lags) if t >= k))
    assert np.allclose(want, fit["errors"], rtol=1e-8, atol=1e-8)


def daily(spark, groups):
    start = D(2024, 1, 1)
    rows = [(k, start + dt.timedelta(days=i), float(v)) for k, ys in groups.items() for i, v in enumerate(ys)]
    return spark.createDataFrame(rows, "k string, date date, revenue double")


def test_range_over_history_and_future(spark):
    df = daily(spark, {"long": series(200), "short": series(20), "flat": np.full(200, 5.0), "tiny": [3.0, 4.0]})
    rows = forecast.forecast_range(df, D(2024, 7, 10), D(2024, 7, 30), by=["k"]).collect()
    by = {k: sorted((r for r in rows if r["k"] == k), key=lambda r: r["date"]) for k in ("long", "short", "flat", "tiny")}
    assert {k: len(v) for k, v in by.items()} == {"long": 21, "short": 21, "flat": 21, "tiny": 21}
    assert {k: v[0]["method"] for k, v in by.items()} == {
        "long": "sarima", "short": "seasonal_naive", "flat": "seasonal_naive", "tiny": "seasonal_naive",
    }
    assert all(r["predicted_revenue"] == 5.0 for r in by["flat"])
    assert all(r["lower"] <= r["predicted_revenue"] <= r["upper"] and r["lower"] >= 0 for r in rows)
    truth = series(220, noise=0)
    first = (D(2024, 7, 10) - D(2024, 1, 1)).days
    assert np.abs([r["predicted_revenue"] - truth[first + i] for i, r in enumerate(by["long"])]).mean() < 2


def test_negative_forecasts_are_clamped(spark):
    df = daily(spark, {"a": 50 - 0.5 * np.arange(120) + np.random.default_rng(0).normal(size=120)})
    rows = forecast.forecast_range(df, D(2024, 6, 1), D(2024, 6, 30), by=["k"]).collect()
    assert min(r["predicted_revenue"] for r in rows) == 0.0


def test_range_order_is_checked(spark):
    df = daily(spark, {"a": series(100)})
    with pytest.raises(ValueError):
        forecast.forecast_range(df, D(2024, 2, 1), D(2024, 1, 1))
    assert forecast.forecast_range(df, D(2023, 1, 1), D(2023, 1, 2), by=["k"]).count() == 0


def test_scenarios_unroll_rows(spark):
    df = spark.createDataFrame([(1, 10.0, 0.2, 5.0)], "k int, units_sold double, discount_applied double, ad_spend double")
    rows = {r["scenario"]: r for r in scoring.with_scenarios(df).collect()}
    assert set(rows) == set(scoring.SCENARIOS)
    assert rows["units_plus_10_percent"]["units_sold"] == pytest.approx(11.0)
    assert rows["half_discount"]["discount_applied"] == pytest.approx(0.1)
    assert rows["double_ad_spend"]["ad_spend"] == 10.0
    assert rows["current"]["units_sold"] == 10.0
