"""Calendar buckets, windows, forecasts by window, quality metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandlens.catalog.base import DAILY, FORECAST, NUMBERED, SALES, query, rounded
from demandlens.catalog.descriptive import forecast
from demandlens.operators import buckets, metrics, ordering, windows, yardstick
from demandlens.operators.importance import data_driven_importance
from demandlens.sources.star import ORDER_KEYS, list_price_scores, sales

# --- buckets ---------------------------------------------------------------------------

BUCKET = """, o AS (SELECT {label} AS date, sum({m}) AS s, count(*) AS n FROM sales GROUP BY 1),
g AS (SELECT CAST({glabel} AS DATE) AS date FROM
 (SELECT unnest(generate_series(date_trunc('{unit}', (SELECT min(date) FROM o)), (SELECT max(date) FROM o), INTERVAL 1 {unit})) AS d))
SELECT g.date, round(coalesce(s, 0.0), 4) AS {m}, coalesce(n, 0) AS transaction_count FROM g LEFT JOIN o ON g.date = o.date"""


def _bucket_sql(unit: str, measure: str = "revenue") -> str:
    def label(d: str) -> str:
        if unit == "day":
            return f"CAST({d} AS DATE)"
        return f"CAST(date_trunc('{unit}', {d}) + INTERVAL 1 {unit} - INTERVAL 1 DAY AS DATE)"

    return SALES + BUCKET.format(label=label("transaction_date"), glabel=label("d"), unit=unit, m=measure)


@query("t1_daily_revenue", _bucket_sql("day"))
def t1(spark, sf):
    return rounded(buckets.bucket(sales(spark, sf, []), "day"))


@query("t2_weekly_units", _bucket_sql("week", "units_sold"))
def t2(spark, sf):
    return rounded(buckets.bucket(sales(spark, sf, []), "week", "units_sold"))


@query("t3_monthly_revenue", _bucket_sql("month"))
def t3(spark, sf):
    return rounded(buckets.bucket(sales(spark, sf, []), "month"))


@query("t4_quarterly_revenue", _bucket_sql("quarter"))
def t4(spark, sf):
    return rounded(buckets.bucket(sales(spark, sf, []), "quarter"))


@query("t5_yearly_revenue", _bucket_sql("year"))
def t5(spark, sf):
    return rounded(buckets.bucket(sales(spark, sf, []), "year"))


@query("t6_weekly_revenue_and_count", _bucket_sql("week"))
def t6(spark, sf):
    return rounded(buckets.bucket(sales(spark, sf, []), "week"))


@query(
    "t7_monthly_by_category",
    SALES
    + """SELECT category, last_day(transaction_date) AS date, round(sum(revenue), 4) AS revenue FROM sales
WHERE category IN ('ECONOMY', 'PROMO', 'STANDARD') GROUP BY 1, 2""",
)
def t7(spark, sf):
    df = sales(spark, sf, ["category"]).filter(F.col("category").isin("ECONOMY", "PROMO", "STANDARD"))
    return rounded(buckets.observed(df, "month", by=["category"]).drop("transaction_count"))


@query(
    "t8_forecast_dates",
    """SELECT CAST(unnest(generate_series(max(CAST(l_shipdate AS DATE)) + 1, max(CAST(l_shipdate AS DATE)) + 30, INTERVAL 1 DAY)) AS DATE)
 AS date FROM lineitem""",
)
def t8(spark, sf):
    last = sales(spark, sf, []).agg(F.max("transaction_date").alias("last"))
    return buckets.date_range(last, F.date_add("last", 1), F.date_add("last", 30))


@query(
    "t9_time_split",
    """, c AS (SELECT CAST(max(transaction_date) - INTERVAL 6 MONTH AS DATE) AS cut FROM sales)
SELECT CASE WHEN transaction_date <= cut THEN 'train' ELSE 'test' END AS part, count(*) AS n,
 min(transaction_date) AS first_date, max(transaction_date) AS last_date FROM sales, c GROUP BY 1""".replace(
        ", c AS", SALES + ", c AS", 1
    ),
)
def t9(spark, sf):
    train, test = buckets.time_split(sales(spark, sf, []))
    parts = [df.withColumn("part", F.lit(p)) for p, df in (("train", train), ("test", test))]
    return parts[0].unionByName(parts[1]).groupBy("part").agg(
        F.count("*").alias("n"),
        F.min("transaction_date").alias("first_date"),
        F.max("transaction_date").alias("last_date"),
    )


# --- windows ---------------------------------------------------------------------------

OVER = "OVER (ORDER BY rn)"


def _frame(width: int) -> str:
    return f"OVER (ORDER BY rn ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"


def _lag_sql() -> str:
    return ", ".join(
        f"round(lag({c}, {k}) {OVER}, 6) AS {m}_lag_{k}"
        for k in (1, 7, 14, 30)
        for m, c in (("revenue", "revenue"), ("units", "units_sold"))
    )


def _roll_sql() -> str:
    return ", ".join(
        f"round(CASE WHEN rn >= {w} THEN avg({c}) {_frame(w)} END, 6) AS {m}_rollmean_{w}"
        for w in (7, 14, 30)
        for m, c in (("revenue", "revenue"), ("units", "units_sold"))
    )


@query("w1_row_lags", NUMBERED + f"SELECT rn, {_lag_sql()} FROM numbered")
def w1(spark, sf):
    df = sales(spark, sf, []).select(*ORDER_KEYS, "revenue", "units_sold")
    out = windows.lag_rolling(df, ORDER_KEYS, rolls=(), keep_row_number=True)
    return rounded(out.select("rn", *windows.lag_columns()), 6)


@query("w2_row_rolling_means", NUMBERED + f"SELECT rn, {_roll_sql()} FROM numbered")
def w2(spark, sf):
    df = sales(spark, sf, []).select(*ORDER_KEYS, "revenue", "units_sold")
    out = windows.lag_rolling(df, ORDER_KEYS, lags=(), keep_row_number=True)
    return rounded(out.select("rn", *windows.rolling_columns()), 6)


MA = """SELECT date, round(revenue, 4) AS revenue, round(avg(revenue) OVER (ORDER BY date ROWS 6 PRECEDING), 6) AS ma_7,
 round(avg(revenue) OVER (ORDER BY date ROWS 13 PRECEDING), 6) AS ma_14 FROM daily"""


@query("w3_moving_averages", DAILY + MA)
def w3(spark, sf):
    out = windows.moving_averages(buckets.daily_series(sales(spark, sf, [])))
    return rounded(out, {"revenue": 4, "ma_7": 6, "ma_14": 6})


@query(
    "w4_short_moving_average",
    FORECAST
    + """SELECT date, round(predicted_revenue, 4) AS predicted_revenue,
 round(avg(predicted_revenue) OVER (ORDER BY date ROWS 6 PRECEDING), 6) AS ma FROM forecast""",
)
def w4(spark, sf):
    return rounded(windows.short_moving_average(forecast(spark, sf)), {"predicted_revenue": 4, "ma": 6})


@query(
    "w5_cumulative_forecast",
    FORECAST
    + """SELECT date, round(predicted_revenue, 4) AS predicted_revenue,
 round(sum(predicted_revenue) OVER (ORDER BY date), 4) AS cumulative_revenue FROM forecast""",
)
def w5(spark, sf):
    return rounded(windows.cumulative(forecast(spark, sf)))


@query(
    "w6_trend",
    FORECAST
    + """, m AS (SELECT date, avg(predicted_revenue) OVER (ORDER BY date ROWS 6 PRECEDING) AS t FROM forecast),
e AS (SELECT arg_min(t, date) AS a, arg_max(t, date) AS b FROM m)
SELECT round(a, 4) AS start_trend, round(b, 4) AS end_trend, round(CASE WHEN a > 0 THEN (b - a) / a * 100 ELSE 0.0 END, 4) AS trend_pct FROM e""",
)
def w6(spark, sf):
    return rounded(windows.trend_summary(forecast(spark, sf)))


@query(
    "w7_decomposition",
    DAILY
    + """, t AS (SELECT date, revenue, CASE WHEN count(*) OVER w = 7 THEN avg(revenue) OVER w END AS trend FROM daily
 WINDOW w AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
s AS (SELECT isodow(date) AS k, avg(revenue - trend) AS e FROM t GROUP BY 1),
c AS (SELECT avg(e) AS m FROM s)
SELECT date, round(revenue, 4) AS revenue, round(trend, 6) AS trend, round(e - m, 4) AS seasonal,
 round(revenue - trend - (e - m), 4) AS residual FROM t JOIN s ON k = isodow(date), c""",
)
def w7(spark, sf):
    out = windows.decompose(buckets.daily_series(sales(spark, sf, [])))
    return rounded(out, {"revenue": 4, "trend": 6, "seasonal": 4, "residual": 4})


@query(
    "w8_forward_fill",
    SALES
    + """, m AS (SELECT category, region, transaction_date AS date, sum(revenue) AS revenue FROM sales GROUP BY 1, 2, 3),
e AS (SELECT category, region, min(date) AS lo, max(date) AS hi FROM m GROUP BY 1, 2),
s AS (SELECT category, region, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM e)
SELECT category, region, date, round(last_value(revenue IGNORE NULLS) OVER (PARTITION BY category, region ORDER BY date), 4) AS revenue
FROM s LEFT JOIN m USING (category, region, date)""",
)
def w8(spark, sf):
    return rounded(buckets.daily_series(sales(spark, sf), by=["category", "region"], fill="ffill"))


@query(
    "w9_share_of_total",
    SALES
    + "SELECT region, round(sum(revenue), 4) AS revenue, round(sum(revenue) / sum(sum(revenue)) OVER (), 6) AS share FROM sales GROUP BY 1",
)
def w9(spark, sf):
    return rounded(windows.share_of_total(sales(spark, sf, ["region"]), ["region"]), {"revenue": 4, "share": 6})


SCORES = """, sc AS (SELECT 'units_sold' AS feature, abs(corr(units_sold, predicted_revenue)) AS s FROM sales
 UNION ALL SELECT 'discount_applied', abs(corr(discount_applied, predicted_revenue)) FROM sales
 UNION ALL SELECT 'clicks', abs(corr(clicks, predicted_revenue)) FROM sales
 UNION ALL SELECT 'ad_spend', abs(corr(ad_spend, predicted_revenue)) FROM sales
 UNION ALL SELECT 'conversion_rate', abs(corr(conversion_rate, predicted_revenue)) FROM sales
 UNION ALL SELECT 'category', greatest(0.1, least(0.9, 1 - (SELECT avg(sd) FROM (SELECT stddev_samp(predicted_revenue) AS sd
   FROM sales GROUP BY category)) / stddev_samp(predicted_revenue))) FROM sales
 UNION ALL SELECT 'region', greatest(0.1, least(0.9, 1 - (SELECT avg(sd) FROM (SELECT stddev_samp(predicted_revenue) AS sd
   FROM sales GROUP BY region)) / stddev_samp(predicted_revenue))) FROM sales),
imp AS (SELECT feature, s / sum(s) OVER () AS importance FROM sc)
"""
FEATURES = (["units_sold", "discount_applied", "clicks", "ad_spend", "conversion_rate"], ["category", "region"])


def _importance(spark, sf):
    df = list_price_scores(spark, sf, ["category", "region", "clicks"])
    return data_driven_importance(df, *FEATURES)


@query(
    "w10_top_features",
    SALES
    + SCORES
    + """SELECT feature, round(importance, 6) AS importance, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank,
 round(sum(importance) OVER (ORDER BY importance DESC, feature) / sum(importance) OVER (), 6) AS cumulative_share
FROM imp QUALIFY rank <= 5""",
)
def w10(spark, sf):
    return rounded(windows.top_features(_importance(spark, sf)), 6)


@query("f8_feature_importance", SALES + SCORES + "SELECT feature, round(importance, 6) AS importance FROM imp")
def f8(spark, sf):
    return rounded(_importance(spark, sf), 6)


@query("w11_row_order", NUMBERED + f"SELECT {', '.join(ORDER_KEYS)}, rn FROM numbered")
def w11(spark, sf):
    return ordering.with_row_number(sales(spark, sf, []).select(ORDER_KEYS), ORDER_KEYS)


# --- yardsticks, metrics ---------------------------------------------------------------

ONE_STEP = """, y AS (SELECT date, revenue, lag(revenue, 7) OVER (ORDER BY date) AS seasonal_naive,
 CASE WHEN row_number() OVER (ORDER BY date) > 7 THEN avg(revenue) OVER (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END
 AS moving_average FROM daily)
"""


@query(
    "m4_yardstick_history",
    DAILY
    + ONE_STEP
    + """SELECT date, round(revenue, 4) AS revenue, round(seasonal_naive, 4) AS seasonal_naive,
 round(moving_average, 6) AS moving_average FROM y""",
)
def m4(spark, sf):
    out = yardstick.one_step(buckets.daily_series(sales(spark, sf, [])))
    return rounded(out, {"revenue": 4, "seasonal_naive": 4, "moving_average": 6})


@query("m4_seasonal_naive_forecast", FORECAST + "SELECT date, round(predicted_revenue, 4) AS predicted_revenue FROM forecast")
def m4_forecast(spark, sf):
    return rounded(forecast(spark, sf))


@query(
    "m6_expanding_folds",
    NUMBERED
    + """, n AS (SELECT count(*) AS n FROM numbered)
SELECT CAST(CASE WHEN rn > n - 3 * (n // 4) THEN (rn - 1 - (n - 3 * (n // 4))) // (n // 4) END AS INTEGER) AS test_fold,
 count(*) AS rows, min(rn) AS first_row, max(rn) AS last_row, min(transaction_date) AS first_date FROM numbered, n GROUP BY 1""",
)
def m6(spark, sf):
    df = ordering.with_row_number(sales(spark, sf, []).select(ORDER_KEYS), ORDER_KEYS)
    return ordering.expanding_folds(df).groupBy("test_fold").agg(
        F.count("*").alias("rows"),
        F.min("rn").alias("first_row"),
        F.max("rn").alias("last_row"),
        F.min("transaction_date").alias("first_date"),
    )


METRIC = """round(avg(abs({a} - {p})), 4) AS mae, round(sqrt(avg(({a} - {p}) * ({a} - {p}))), 4) AS rmse,
 round(1 - sum(({a} - {p}) * ({a} - {p})) / (var_pop({a}) * count({a})), 6) AS r2,
 round(avg(abs({a} - {p}) / nullif(abs({a}), 0)), 6) AS mape"""
SALE_METRIC = METRIC.format(a="revenue", p="predicted_revenue")
METRIC_DIGITS = {"mae": 4, "rmse": 4, "r2": 6, "mape": 6}


@query("m8_metrics", SALES + f"SELECT {SALE_METRIC}, count(*) AS n FROM sales")
def m8(spark, sf):
    return rounded(metrics.metrics(list_price_scores(spark, sf, [])), METRIC_DIGITS)


@query(
    "m8_model_comparison",
    DAILY
    + ONE_STEP
    + f""", a AS (SELECT 'seasonal_naive' AS model, {METRIC.format(a='revenue', p='seasonal_naive')} FROM y WHERE seasonal_naive IS NOT NULL
 UNION ALL SELECT 'moving_average', {METRIC.format(a='revenue', p='moving_average')} FROM y WHERE moving_average IS NOT NULL)
SELECT model, metric, round(value, 4) AS value FROM (UNPIVOT a ON mae, rmse, r2, mape INTO NAME metric VALUE value)""",
)
def m8_compare(spark, sf):
    df = yardstick.one_step(buckets.daily_series(sales(spark, sf, [])))
    models = {"seasonal_naive": "seasonal_naive", "moving_average": "moving_average"}
    return rounded(metrics.compare_models(df, models), 4)


@query(
    "m9_metrics_by_category",
    SALES + f"SELECT category, {SALE_METRIC}, count(*) AS n FROM sales GROUP BY 1",
)
def m9(spark, sf):
    return rounded(metrics.metrics(list_price_scores(spark, sf, ["category"]), by=["category"]), METRIC_DIGITS)


@query("m9_metrics_by_region", SALES + f"SELECT region, {SALE_METRIC}, count(*) AS n FROM sales GROUP BY 1")
def m9_region(spark, sf):
    return rounded(metrics.metrics(list_price_scores(spark, sf, ["region"]), by=["region"]), METRIC_DIGITS)


@query(
    "m10_residual_statistics",
    SALES
    + """SELECT round(avg(revenue - predicted_revenue), 4) AS residual_mean,
 round(stddev_samp(revenue - predicted_revenue), 4) AS residual_std, count(*) AS n FROM sales""",
)
def m10_stats(spark, sf):
    return rounded(metrics.residual_statistics(list_price_scores(spark, sf, [])))


@query(
    "m10_high_residuals",
    SALES
    + f""", r AS (SELECT *, revenue - predicted_revenue AS residual FROM sales),
st AS (SELECT avg(residual) AS m, stddev_samp(residual) AS s FROM r)
SELECT {', '.join(ORDER_KEYS)}, round(residual, 4) AS residual FROM r, st WHERE abs(residual - m) > 2 * s""",
)
def m10(spark, sf):
    df = metrics.high_residuals(list_price_scores(spark, sf, []))
    return rounded(df.select(*ORDER_KEYS, "residual"), {"residual": 4})


@query(
    "m10_residual_histogram",
    SALES
    + """, v AS (SELECT revenue - predicted_revenue AS x FROM sales), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
b AS (SELECT CAST(least(floor((x - lo) / (hi - lo) * 30), 29) AS INTEGER) AS bin, lo, hi FROM v, e)
SELECT bin, round(min(lo) + bin * (min(hi) - min(lo)) / 30, 4) AS bin_start, count(*) AS count,
 round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM b GROUP BY bin""",
)
def m10_hist(spark, sf):
    return rounded(metrics.residual_histogram(list_price_scores(spark, sf, [])), {"bin_start": 4, "percent": 6})


@query(
    "m12_forecast_interval",
    FORECAST
    + """, sd AS (SELECT stddev_samp(predicted_revenue) * 0.2 AS s FROM forecast)
SELECT date, round(predicted_revenue, 4) AS predicted_revenue, round(greatest(predicted_revenue - 1.645 * s, 0.0), 4) AS lower_bound,
 round(predicted_revenue + 1.645 * s, 4) AS upper_bound FROM forecast, sd""",
)
def m12(spark, sf):
    return rounded(yardstick.with_interval(forecast(spark, sf), 0.9))


# The last half year is checked against the metrics of the time before it.
CHECK = (
    SALES
    + f""", cut AS (SELECT CAST(max(transaction_date) - INTERVAL 6 MONTH AS DATE) AS c FROM sales),
base AS (SELECT {SALE_METRIC} FROM sales, cut WHERE transaction_date <= c),
recent AS (SELECT sales.* FROM sales, cut WHERE transaction_date > c),
now AS (SELECT {SALE_METRIC}, count(*) AS n FROM recent),
st AS (SELECT avg(revenue - predicted_revenue) AS m, stddev_samp(revenue - predicted_revenue) AS s FROM recent),
hr AS (SELECT count(*) AS h FROM recent, st WHERE abs(revenue - predicted_revenue - m) > 2 * s)
"""
)


@query(
    "m15_monitoring_check",
    CHECK
    + """SELECT now.mae, now.rmse, now.r2, now.mape, now.n, base.mae AS baseline_mae, base.r2 AS baseline_r2, h AS high_residuals
FROM now, base, hr""",
)
def m15(spark, sf):
    train, test = buckets.time_split(list_price_scores(spark, sf, []))
    base = metrics.metrics(train).agg(F.struct(F.first("mae").alias("mae"), F.first("r2").alias("r2")).alias("b")).scalar()
    high = metrics.high_residuals(test).agg(F.count("*")).scalar()
    out = metrics.metrics(test).select(
        "*", base["mae"].alias("baseline_mae"), base["r2"].alias("baseline_r2"), high.alias("high_residuals")
    )
    return rounded(out, {**METRIC_DIGITS, "baseline_mae": 4, "baseline_r2": 6})


@query(
    "m16_alerts",
    CHECK
    + """, a AS (SELECT 'ALERT' AS level, 'r2' AS metric, now.r2 AS value, 0.7::DOUBLE AS threshold, base.r2 AS baseline
  FROM now, base WHERE now.r2 < 0.7 AND now.r2 < 0.9 * base.r2
 UNION ALL SELECT 'ALERT', 'mae', now.mae, 100.0, base.mae FROM now, base WHERE now.mae > 100 AND now.mae > 1.1 * base.mae
 UNION ALL SELECT 'WARNING', 'high_residuals', h, 0, NULL FROM hr WHERE h > 0)
SELECT level, metric, CAST(value AS DOUBLE) AS value, CAST(threshold AS DOUBLE) AS threshold, CAST(baseline AS DOUBLE) AS baseline FROM a""",
)
def m16(spark, sf):
    train, test = buckets.time_split(list_price_scores(spark, sf, []))
    high = metrics.high_residuals(test).agg(F.count("*"))
    out = metrics.alerts(
        rounded(metrics.metrics(test), METRIC_DIGITS), rounded(metrics.metrics(train), METRIC_DIGITS), high, mae_max=100.0
    )
    return out.drop("message")


@query(
    "m17_best_model",
    DAILY
    + ONE_STEP
    + f""", a AS (SELECT 'seasonal_naive' AS model, {METRIC.format(a='revenue', p='seasonal_naive')} FROM y WHERE seasonal_naive IS NOT NULL
 UNION ALL SELECT 'moving_average', {METRIC.format(a='revenue', p='moving_average')} FROM y WHERE moving_average IS NOT NULL)
SELECT model, mae, rmse, r2 FROM a ORDER BY mae, model LIMIT 1""",
)
def m17(spark, sf):
    df = yardstick.one_step(buckets.daily_series(sales(spark, sf, [])))
    models = {"seasonal_naive": "seasonal_naive", "moving_average": "moving_average"}
    return rounded(metrics.best_model(metrics.compare_models(df, models)), {"mae": 4, "rmse": 4, "r2": 6})
