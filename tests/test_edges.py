"""Edge rows from the fixture list, on literal frames."""

import datetime as dt

import numpy as np
import pytest
from demandlens.functions import calendar as cal
from demandlens.functions import numeric as num
from demandlens.operators import aggregate as agg
from demandlens.operators import align, buckets, distribution, metrics, ordering, windows, yardstick
from demandlens.operators import features as fp
from demandlens.operators import select as sel
from demandlens.operators.quantiles import exact_quantiles
from demandlens.sources import schemas
from pyspark.sql import functions as F

D = dt.date


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.fixture
def gap(spark):
    return frame(spark, [(D(2024, 1, 1), 1.0), (D(2024, 1, 4), 2.0)], "transaction_date date, revenue double")


def values(df, column="revenue", order="date"):
    return [r[column] for r in df.orderBy(order).collect()]


def test_gap_fill(gap):
    assert values(buckets.daily_series(gap)) == [1.0, 0.0, 0.0, 2.0]
    assert values(buckets.daily_series(gap, fill="ffill")) == [1.0, 1.0, 1.0, 2.0]
    assert values(buckets.daily_series(gap, fill="none")) == [1.0, 2.0]
    with pytest.raises(ValueError):
        buckets.daily_series(gap, fill="mean")


def test_empty_buckets_count_zero(gap):
    assert values(buckets.bucket(gap, "day"), "transaction_count") == [1, 0, 0, 1]


@pytest.mark.parametrize(
    "grain, label",
    [("week", D(2024, 9, 1)), ("month", D(2024, 8, 31)), ("quarter", D(2024, 9, 30)), ("year", D(2024, 12, 31))],
)
def test_bucket_labels(spark, grain, label):
    df = frame(spark, [(D(2024, 8, 31),)], "d date").select(cal.bucket_end("d", grain).alias("x"))
    assert one(df)["x"] == label


@pytest.mark.parametrize("grain", ["day", "week", "month", "quarter", "year"])
def test_spine_is_regular_over_years(spark, grain):
    df = frame(spark, [(D(2019, 1, 31), 1.0), (D(2024, 2, 29), 1.0)], "transaction_date date, revenue double")
    got = [r["date"] for r in buckets.bucket(df, grain).orderBy("date").collect()]
    days = [D(2019, 1, 31) + dt.timedelta(days=i) for i in range((D(2024, 2, 29) - D(2019, 1, 31)).days + 1)]
    labels = {
        "day": lambda d: d,
        "week": lambda d: d + dt.timedelta(days=6 - d.weekday()),
        "month": lambda d: _end(d.year, d.month),
        "quarter": lambda d: _end(d.year, (d.month + 2) // 3 * 3),
        "year": lambda d: D(d.year, 12, 31),
    }[grain]
    assert got == sorted({labels(d) for d in days})


def _end(year, month):
    return (D(year + month // 12, month % 12 + 1, 1)) - dt.timedelta(days=1)


def test_split_date_clamps_to_month_end(spark):
    df = frame(spark, [(D(2024, 8, 31),)], "transaction_date date")
    assert one(buckets.split_date(df))["split_date"] == D(2024, 2, 29)


def test_calendar_edges(spark):
    df = frame(spark, [(D(2021, 1, 3),), (D(2024, 12, 30),), (D(2024, 8, 31),), (D(2024, 4, 10),)], "d date")
    rows = {r["d"]: r for r in df.select("d", *[c.alias(n) for n, c in cal.calendar_features("d").items()]).collect()}
    assert rows[D(2021, 1, 3)]["weekofyear"] == 53
    assert rows[D(2024, 12, 30)]["weekofyear"] == 1
    assert (rows[D(2024, 8, 31)]["dayofweek"], rows[D(2024, 8, 31)]["is_weekend"]) == (5, 1)
    assert rows[D(2024, 4, 10)]["is_holiday"] == 1
    assert rows[D(2024, 12, 30)]["season_winter"] == 1
    assert rows[D(2024, 12, 30)]["season_spring"] == rows[D(2024, 12, 30)]["season_summer"] == 0


def test_two_keys_fill_nothing(spark):
    rows = [(D(2024, 1, 5), "a", 1.0), (D(2024, 3, 5), "a", 1.0), (D(2024, 3, 6), "b", 1.0)]
    df = frame(spark, rows, "transaction_date date, category string, revenue double")
    assert buckets.bucket(df, "month").count() == 3
    assert buckets.observed(df, "month", by=["category"]).count() == 3
    assert buckets.bucket(df, "month", by=["category"]).count() == 4


def test_scalars(spark):
    row = one(
        spark.range(1).select(
            num.round_half_even(F.lit(0.125)).alias("half"),
            num.round_half_even(F.lit(1.015)).alias("binary"),
            num.log1p_clamped(F.lit(-2.0)).alias("log"),
            num.expm1_clamped(F.lit(-3.0)).alias("exp"),
            num.clip_low(F.lit(-1.0)).alias("clip"),
            num.clamp(F.lit(2.0), 0.1, 0.9).alias("clamp"),
            num.percent_difference(F.lit(1.0), F.lit(0.0)).alias("pct"),
            num.currency(F.lit(1234.5)).alias("money"),
            num.to_number(F.lit("x")).alias("bad"),
            num.min_max(F.lit(5.0), 5.0, 5.0).alias("constant"),
            num.min_max(F.lit(3.0), 0.0, 2.0).alias("above"),
        )
    )
    assert (row["half"], row["binary"]) == (0.12, float(np.round(1.015, 2)))
    assert (row["log"], row["exp"], row["clip"], row["clamp"], row["pct"]) == (0.0, 0.0, 0.0, 0.9, 0.0)
    assert row["money"] == "$1,234.50"
    assert row["bad"] is None
    assert (row["constant"], row["above"]) == (0.0, 1.5)


def test_constant_column_has_no_correlation(spark):
    df = frame(spark, [(5.0, 1.0), (5.0, 2.0)], "a double, b double")
    assert one(agg.correlation_pairs(df, ["a", "b"]))["r"] is None


def test_correlation_uses_complete_pairs_only(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a) if i % 7 else None, float(b) if i % 5 else None) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    r = one(agg.correlation_pairs(frame(spark, rows, "a double, b double"), ["a", "b"]))["r"]
    both = np.array([x for x in rows if None not in x])
    assert r == pytest.approx(np.corrcoef(both.T)[0, 1])


# --- quantiles -------------------------------------------------------------------------


def check_quantiles(spark, data, probabilities=(0.0, 0.25, 0.5, 0.75, 0.9, 1.0)):
    df = frame(spark, [(k, float(v)) for k, vs in data.items() for v in vs], "k string, v double")
    got = {(r["k"], r["probability"]): r["quantile"] for r in exact_quantiles(df, ["v"], list(probabilities), by=["k"]).collect()}
    for k, vs in data.items():
        for p in probabilities:
            assert got[(k, p)] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-12), (k, p)


def test_quartiles_of_four(spark):
    df = frame(spark, [(float(i),) for i in (1, 2, 3, 4)], "v double")
    got = [r["quantile"] for r in exact_quantiles(df, ["v"], [0.25, 0.5, 0.75]).orderBy("probability").collect()]
    assert got == [1.75, 2.5, 3.25]


def test_quantiles_small_groups(spark):
    rng = np.random.default_rng(0)
    check_quantiles(spark, {str(n): rng.normal(size=n) for n in (1, 2, 3, 5, 8, 101)})


def test_quantiles_beyond_the_small_group_limit(spark):
    rng = np.random.default_rng(0)
    data = {
        "normal": rng.normal(size=60_000),
        "heavy": np.exp(3 * rng.normal(size=50_000)),
        "few": rng.integers(0, 7, size=40_000),
        "hot": np.where(rng.random(45_000) < 0.4, 3.0, rng.normal(size=45_000)),
        "constant": np.full(30_000, 2.0),
    }
    check_quantiles(spark, data)


def test_quantiles_skip_nulls_and_empty_columns(spark):
    df = frame(spark, [(1.0, None), (None, None), (3.0, None)], "a double, b double")
    rows = exact_quantiles(df, ["a", "b"], [0.5]).collect()
    assert [(r["column"], r["quantile"]) for r in rows] == [("a", 2.0)]


def test_box_statistics(spark):
    df = frame(spark, [("a", float(v)) for v in (1, 2, 3, 4, 100)], "k string, revenue double")
    row = one(distribution.box_statistics(df, "k"))
    assert (row["q1"], row["median"], row["q3"]) == (2.0, 3.0, 4.0)
    assert (row["whisker_low"], row["whisker_high"], row["outliers"]) == (1.0, 4.0, 1)


def test_histogram_edges(spark):
    df = frame(spark, [(0.0,), (5.0,), (10.0,)], "revenue double")
    got = {r["bin"]: r["count"] for r in distribution.histogram(df, bins=2).collect()}
    assert got == {0: 1, 1: 2}
    same = frame(spark, [(4.0,), (4.0,)], "revenue double")
    assert one(distribution.histogram(same))["count"] == 2
    assert one(distribution.automatic_bins(same))["bins"] == 1


def test_automatic_bins_like_numpy(spark):
    x = np.random.default_rng(3).normal(size=500)
    df = frame(spark, [(float(v),) for v in x], "revenue double")
    assert one(distribution.automatic_bins(df))["bins"] == len(np.histogram_bin_edges(x, "auto")) - 1
    assert distribution.histogram_auto(df).agg(F.sum("count")).first()[0] == 500


# --- order and windows -----------------------------------------------------------------


def test_row_numbers_with_a_hot_day(spark):
    """A third of all rows on one day must be spread and still be in order."""
    rng = np.random.default_rng(0)
    days = np.where(rng.random(30_000) < 0.34, 50, rng.integers(0, 100, 30_000))
    rows = [(int(d), int(i)) for d, i in zip(days, rng.permutation(30_000))]
    df = frame(spark, rows, "d int, i int")
    numbered = ordering.with_row_number(df, ["d", "i"], partitions=16)
    got = [(r["d"], r["i"]) for r in numbered.orderBy("rn").collect()]
    assert got == sorted(rows)
    assert numbered.agg(F.min("rn"), F.max("rn"), F.count_distinct("rn")).first()[:] == (1, 30_000, 30_000)


@pytest.mark.parametrize("block", [30, 31, 64, 1000])
def test_lags_across_blocks(spark, block):
    n = 257
    rows = [(i, float((i * 37) % 101), float(i % 9)) for i in range(n)]
    df = frame(spark, rows, "t int, revenue double, units_sold double")
    out = windows.lag_rolling(df, ["t"], keep_row_number=True, block_rows=block).orderBy("rn").collect()
    assert len(out) == n
    for i, r in enumerate(out):
        for k in windows.LAGS:
            assert r[f"revenue_lag_{k}"] == (rows[i - k][1] if i >= k else None)
        for w in windows.ROLLS:
            want = np.mean([x[2] for x in rows[i - w + 1 : i + 1]]) if i >= w - 1 else None
            assert r[f"units_rollmean_{w}"] == (pytest.approx(want) if want is not None else None)


def test_rolling_without_current_row(spark):
    df = frame(spark, [(i, float(i), 0.0) for i in range(10)], "t int, revenue double, units_sold double")
    out = windows.lag_rolling(df, ["t"], lags=(), rolls=(7,), exclude_current=True, keep_row_number=True)
    assert values(out, "revenue_rollmean_7", "rn") == [None] * 7 + [3.0, 4.0, 5.0]


def test_short_series(spark):
    df = frame(spark, [(D(2024, 1, i + 1), float(i)) for i in range(5)], "date date, revenue double")
    assert values(windows.series_lag_rolling(df, "revenue", (), (7,)), "revenue_rollmean_7") == [None] * 5
    assert values(windows.moving_averages(df, more_than=3), "ma_7") == [0.0, 0.5, 1.0, 1.5, 2.0]
    assert values(windows.moving_averages(df), "ma_7") == [None] * 5


def test_trend_of_zero_start(spark):
    df = frame(spark, [(D(2024, 1, i + 1), float(i)) for i in range(3)], "date date, predicted_revenue double")
    assert one(windows.trend_summary(df))["trend_pct"] == 0.0


def test_decomposition_adds_up_per_series(spark):
    rng = np.random.default_rng(0)
    rows = [(k, D(2024, 1, 1) + dt.timedelta(days=i), float(10 + i + 5 * (i % 7 == 2) + rng.normal())) for k in "ab" for i in range(70)]
    df = frame(spark, rows, "k string, date date, revenue double")
    out = windows.decompose(df, by=["k"]).filter("trend is not null").collect()
    assert len(out) == 2 * 64
    assert all(r["trend"] + r["seasonal"] + r["residual"] == pytest.approx(r["revenue"]) for r in out)
    assert sum({(r["k"], r["date"].weekday()): r["seasonal"] for r in out if r["k"] == "a"}.values()) == pytest.approx(0, abs=1e-9)


def test_expanding_folds(spark):
    df = frame(spark, [(i,) for i in range(1, 11)], "rn bigint")
    folds = {r["rn"]: r["test_fold"] for r in ordering.expanding_folds(df).collect()}
    assert folds == {1: None, 2: None, 3: None, 4: None, 5: 0, 6: 0, 7: 1, 8: 1, 9: 2, 10: 2}
    table = {r["fold"]: (r["train_rows"], r["test_rows"]) for r in ordering.fold_table(df).collect()}
    assert table == {0: (4, 2), 1: (6, 2), 2: (8, 2)}
    for fold in range(3):
        train, test = ordering.fold_filter(fold, 10)
        assert df.filter(train).count() == table[fold][0]
        assert [r[0] for r in df.filter(test).orderBy("rn").collect()] == [k for k, v in folds.items() if v == fold]


def test_seasonal_naive_forecast(spark):
    df = frame(spark, [(D(2024, 1, i + 1), float(i)) for i in range(10)], "date date, revenue double")
    out = yardstick.seasonal_naive_forecast(df, 9)
    assert values(out, "predicted_revenue") == [3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 3.0, 4.0]
    assert values(out, "date")[0] == D(2024, 1, 11)
    assert yardstick.seasonal_naive_forecast(df, 3).count() == 3


# --- fitted steps ----------------------------------------------------------------------


def test_unknown_category_is_all_zero(spark):
    df = frame(spark, [("a",), ("b",)], "category string")
    cats = fp.fit_categories(df, ["category"])
    new = frame(spark, [("z",), (None,), ("b",)], "category string")
    rows = new.select("category", *[c.alias(n) for n, c in fp.one_hot(cats).items()]).collect()
    assert [tuple(r[1:]) for r in rows] == [(0.0, 0.0), (0.0, 0.0), (0.0, 1.0)]
    assert one(fp.unseen_values(new, cats))["value"] == "z"


def test_too_many_categories(spark):
    df = spark.range(fp.MAX_CATEGORIES + 1).select(F.col("id").cast("string").alias("category"))
    with pytest.raises(ValueError, match="categories"):
        fp.fit_categories(df, ["category"])


def test_fitted_state_round_trip(spark, tmp_path):
    prep = fp.Preparation(
        categories={"region": ["x", "y"], "category": ["b", "c"]},
        outliers={"clicks": {"q1": 1.0, "median": 2.0, "q3": 3.0, "lower": -2.0, "upper": 6.0}},
        ranges={"clicks": (1.0, 5.0), "ad_cpc": (0.0, 1.0)},
        log_columns=["revenue"],
        dropped=["impressions"],
        feature_columns=["b", "a"],
    )
    prep.save(spark, str(tmp_path / "prep"))
    assert fp.Preparation.load(spark, str(tmp_path / "prep")) == prep
    with pytest.raises(FileNotFoundError, match="fit_stats"):
        fp.Preparation.load(spark, str(tmp_path / "nothing"))


def test_outliers_over_flags_wipe_small_categories(spark):
    rows = [(float(i), "abcde"[i % 5], "r") for i in range(50)]
    df = frame(spark, rows, "clicks double, category string, region string")
    plain = fp.fit_preparation(df, ["clicks"], dropped=())
    assert set(plain.outliers) == {"clicks"}
    parity = fp.fit_preparation(df, ["clicks"], dropped=(), include_onehot=True)
    flags = df.withColumns(fp.one_hot(parity.categories)).withColumns(fp.replace_outliers(parity.outliers))
    assert flags.agg(F.sum("category_a")).first()[0] == 0.0


def test_column_sets(spark):
    assert sel.column_difference(["a", "b"], ["b", "c"]) == (["a"], ["c"])
    assert sel.columns_like(["revenue_lag_1", "season_x", "y"], ("lag",), ("season_",)) == ["revenue_lag_1", "season_x"]
    assert sel.columns_matching(["a1", "b"], r"^a\d") == ["a1"]
    df = frame(spark, [(1, 2)], "b int, x int")
    assert sel.align_columns(df, ["a", "b"]).collect()[0][:] == (0.0, 1.0)


def test_seeded_sample_is_repeatable(spark):
    df = spark.range(1000)
    a = {r["id"] for r in sel.seeded_sample(df, ["id"], 100).collect()}
    b = {r["id"] for r in sel.seeded_sample(df.repartition(7), ["id"], 100).collect()}
    assert a == b and len(a) == 100
    assert a != {r["id"] for r in sel.seeded_sample(df, ["id"], 100, seed=1).collect()}


def test_duplicates_and_days(spark):
    df = frame(spark, [(1,), (1,), (2,), (None,), (None,)], "a int")
    assert one(agg.duplicate_rows(df))["duplicate_rows"] == 2
    days = align.in_day_order(frame(spark, [("Friday", 1.0)], "day_of_week string, v double")).orderBy("day_position")
    assert [r["v"] for r in days.collect()] == [None, None, None, None, 1.0, None, None]


# --- quality and alerts ----------------------------------------------------------------


def test_metrics_by_hand(spark):
    y, p = np.array([1.0, 2.0, 4.0]), np.array([1.5, 2.0, 3.0])
    df = frame(spark, [(float(a), float(b)) for a, b in zip(y, p)] + [(None, 1.0)], "revenue double, predicted_revenue double")
    row = one(metrics.metrics(df))
    assert row["n"] == 3
    assert row["mae"] == pytest.approx(np.abs(y - p).mean())
    assert row["rmse"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert row["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_far_outlier_is_flagged(spark):
    rows = [(i, 0.0, float(i % 3)) for i in range(19)] + [(99, 0.0, 500.0)]
    df = frame(spark, rows, "k int, revenue double, predicted_revenue double")
    assert one(metrics.high_residuals(df))["k"] == 99


def test_alert_rules(spark):
    now = frame(spark, [(0.5, 80.0)], "r2 double, mae double")
    base = frame(spark, [(0.85, 50.0)], schemas.BASELINE)
    fired = {r["metric"]: r for r in metrics.alerts(now, base).collect()}
    assert set(fired) == {"r2", "mae"}
    assert fired["mae"]["threshold"] == pytest.approx(55.0)
    assert metrics.alerts(now, frame(spark, [], schemas.BASELINE)).count() == 0
    close = frame(spark, [(0.68, 52.0)], "r2 double, mae double")
    assert metrics.alerts(close, frame(spark, [(0.7, 50.0)], schemas.BASELINE)).count() == 0
    many = frame(spark, [(3,)], "n bigint").agg(F.max("n"))
    assert one(metrics.alerts(close, base, many).filter("metric = 'high_residuals'"))["value"] == 3.0


def test_interval_levels(spark):
    df = frame(spark, [(D(2024, 1, i + 1), float(i * 100)) for i in range(5)], "date date, predicted_revenue double")
    sd = np.std([0, 100, 200, 300, 400], ddof=1) * 0.2
    last = yardstick.with_interval(df, 0.95).orderBy("date").collect()
    assert last[0]["lower_bound"] == 0.0
    assert last[4]["upper_bound"] == pytest.approx(400 + 1.96 * sd)
