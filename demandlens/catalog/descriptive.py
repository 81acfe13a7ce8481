"""Sources, projections, filters, alignments and aggregations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from demandlens.catalog.base import DAILY, FORECAST, SALES, query, rounded
from demandlens.functions import calendar as cal
from demandlens.functions import numeric as num
from demandlens.operators import aggregate as agg
from demandlens.operators import align, buckets, distribution, windows, yardstick
from demandlens.operators import select as sel
from demandlens.session import stage
from demandlens.sources import readers, schemas
from demandlens.sources.star import AD_COLUMNS, ORDER_KEYS, REGIONS, list_price_scores, sales

KEYS = ORDER_KEYS
NUMERIC = [
    "units_sold", "discount_applied", "revenue", "clicks", "impressions",
    "conversion_rate", "ad_ctr", "ad_cpc", "ad_spend",
]
KEY_SQL = ", ".join(KEYS)


def forecast(spark, sf):
    daily = buckets.daily_series(sales(spark, sf, []))
    return yardstick.seasonal_naive_forecast(daily, 60)


# --- sources ---------------------------------------------------------------------------


@query(
    "j7_sales_star_join",
    SALES
    + f"""SELECT {KEY_SQL}, customer_id, product_id, category, region, units_sold, discount_applied,
 round(revenue, 6) AS revenue, clicks, impressions, round(conversion_rate, 6) AS conversion_rate,
 round(ad_ctr, 6) AS ad_ctr, ad_cpc, round(ad_spend, 4) AS ad_spend FROM sales""",
)
def j7(spark, sf):
    df = sales(spark, sf, enforce=True).drop("list_price")
    return rounded(df, {"revenue": 6, "conversion_rate": 6, "ad_ctr": 6, "ad_spend": 4})


@query(
    "s1_scan_sales",
    """SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS transaction_date, l_quantity AS units_sold,
 l_discount AS discount_applied, round(l_extendedprice * (1 - l_discount), 6) AS revenue FROM lineitem""",
)
def s1(spark, sf):
    df = sales(spark, sf, [])
    cols = ["l_orderkey", "l_linenumber", "transaction_date", "units_sold", "discount_applied", "revenue"]
    return rounded(df.select(cols), {"revenue": 6})


def _raw_requests(spark, sf):
    """Requests as text, with faults that depend on the row so that some are rejected."""
    df = sales(spark, sf, ["category", "region", *AD_COLUMNS])
    k = F.col("l_orderkey")
    text = {c: F.col(c).cast("string") for c in NUMERIC if c != "revenue"}
    text["units_sold"] = F.when(k % 97 == 0, "x").otherwise(text["units_sold"])
    text["transaction_date"] = F.when(k % 89 == 0, "bad").otherwise(F.date_format("transaction_date", "yyyy-MM-dd"))
    text["region"] = F.when(k % 83 != 0, F.col("region"))
    return df.withColumns(text).select("l_orderkey", *schemas.REQUEST_FIELDS)


@query(
    "s2_valid_requests",
    SALES
    + """SELECT category, count(*) AS n, round(sum(units_sold), 2) AS units, min(transaction_date) AS first_date,
 max(transaction_date) AS last_date FROM sales
WHERE l_orderkey % 97 <> 0 AND l_orderkey % 89 <> 0 AND l_orderkey % 83 <> 0 GROUP BY category""",
)
def s2(spark, sf):
    ok = readers.valid_rows(readers.validate_requests(_raw_requests(spark, sf)))
    return rounded(
        ok.groupBy("category").agg(
            F.count("*").alias("n"),
            F.sum("units_sold").alias("units"),
            F.min("transaction_date").alias("first_date"),
            F.max("transaction_date").alias("last_date"),
        ),
        2,
    )


@query(
    "s4_rejected_requests",
    SALES
    + """SELECT reject_reason, count(*) AS n FROM (SELECT concat_ws('; ',
   CASE WHEN l_orderkey % 97 = 0 THEN 'units_sold: not a number' END,
   CASE WHEN l_orderkey % 83 = 0 THEN 'region: missing' END,
   CASE WHEN l_orderkey % 89 = 0 THEN 'transaction_date: not a date' END) AS reject_reason FROM sales)
WHERE reject_reason <> '' GROUP BY 1""",
)
def s4(spark, sf):
    bad = readers.rejected_rows(readers.validate_requests(_raw_requests(spark, sf)))
    return bad.groupBy("reject_reason").agg(F.count("*").alias("n"))


@query(
    "s5_parse_dates",
    "SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM lineitem GROUP BY 1",
)
def s5(spark, sf):
    text = F.date_format("transaction_date", "yyyy-MM-dd")
    df = sales(spark, sf, []).select(readers.parse_date(text).alias("day"))
    return df.groupBy("day").agg(F.count("*").alias("n"))


@query(
    "s13_latest_rows",
    SALES
    + f"SELECT {KEY_SQL}, round(revenue, 6) AS revenue FROM sales ORDER BY "
    + ", ".join(f"{k} DESC" for k in KEYS)
    + " LIMIT 50",
)
def s13(spark, sf):
    df = sales(spark, sf, []).select(*KEYS, "revenue")
    return rounded(sel.latest_rows(df, KEYS, 50), {"revenue": 6})


# --- projections and filters -----------------------------------------------------------


@query(
    "p1_drop_ids",
    SALES + "SELECT category, region, units_sold, discount_applied, round(revenue, 6) AS revenue FROM sales",
)
def p1(spark, sf):
    df = sales(spark, sf, ["customer_id", "category", "region"])
    df = sel.drop_columns(df, [*sel.ID_COLUMNS, *KEYS])
    return rounded(df.select("category", "region", "units_sold", "discount_applied", "revenue"), {"revenue": 6})


@query(
    "p2_drop_correlated",
    SALES
    + """SELECT l_orderkey, l_linenumber, clicks, round(conversion_rate, 6) AS conversion_rate, ad_cpc,
 round(ad_spend, 4) AS ad_spend FROM sales""",
)
def p2(spark, sf):
    df = sales(spark, sf, AD_COLUMNS).select("l_orderkey", "l_linenumber", *AD_COLUMNS)
    df = sel.drop_columns(df, [*sel.CORRELATED_COLUMNS, "not_there"])
    return rounded(df, {"conversion_rate": 6, "ad_spend": 4})


@query("p3_drop_target", SALES + "SELECT l_orderkey, units_sold, category FROM sales")
def p3(spark, sf):
    df = sales(spark, sf, ["category"]).select("l_orderkey", "units_sold", "category", "revenue")
    return sel.drop_columns(df, ["revenue"])


@query("p4_keep_existing", SALES + "SELECT transaction_date, category, region, units_sold FROM sales")
def p4(spark, sf):
    df = sales(spark, sf, ["category", "region"])
    return sel.keep_existing(df, ["transaction_date", "category", "region", "units_sold", "age", "gender"])


@query(
    "p5_columns_by_pattern",
    """SELECT CASE WHEN month(l_shipdate) IN (3,4,5) THEN 1 ELSE 0 END AS season_spring,
 CASE WHEN month(l_shipdate) IN (6,7,8) THEN 1 ELSE 0 END AS season_summer,
 CASE WHEN month(l_shipdate) IN (12,1,2) THEN 1 ELSE 0 END AS season_winter, count(*) AS n
FROM lineitem GROUP BY 1, 2, 3""",
)
def p5(spark, sf):
    df = sales(spark, sf, []).withColumns(cal.calendar_features("transaction_date"))
    names = sel.columns_like(df.columns, contains=("lag", "rollmean"), prefix=("season_",))
    return df.select(names).groupBy(*names).agg(F.count("*").alias("n"))


@query(
    "p6_align_columns",
    SALES + "SELECT l_orderkey, 0.0::DOUBLE AS clicks_lag, units_sold, 0.0::DOUBLE AS season_x, discount_applied FROM sales",
)
def p6(spark, sf):
    df = sales(spark, sf, [])
    return sel.align_columns(df, ["clicks_lag", "units_sold", "season_x", "discount_applied"], keep=["l_orderkey"])


RANGE = (dt.date(1997, 1, 1), dt.date(1997, 6, 30))


@query(
    "p7_between_dates",
    SALES
    + """SELECT l_orderkey, l_linenumber, transaction_date, round(revenue, 6) AS revenue FROM sales
WHERE transaction_date BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'""",
)
def p7(spark, sf):
    df = sel.between_dates(sales(spark, sf, []), *RANGE)
    return rounded(df.select("l_orderkey", "l_linenumber", "transaction_date", "revenue"), {"revenue": 6})


@query(
    "p7_single_day",
    SALES + "SELECT count(*) AS n, round(sum(revenue), 4) AS revenue FROM sales WHERE transaction_date = DATE '1997-03-01'",
)
def p7_day(spark, sf):
    df = sel.between_dates(sales(spark, sf, []), dt.date(1997, 3, 1))
    return rounded(df.agg(F.count("*").alias("n"), F.sum("revenue").alias("revenue")))


@query(
    "p8_members",
    SALES
    + """SELECT category, region, count(*) AS n FROM sales WHERE category IN ('ECONOMY', 'PROMO') GROUP BY 1, 2""",
)
def p8(spark, sf):
    df = sales(spark, sf, ["category", "region"])
    df = sel.members(sel.members(df, "category", ["ECONOMY", "PROMO"]), "region", ["All"])
    return agg.count_by(df, ["category", "region"]).withColumnRenamed("count", "n")


@query(
    "p9_range_comparison",
    SALES
    + """, t AS (SELECT count(*) FILTER (WHERE units_sold BETWEEN 10 AND 25) AS filtered_records, count(*) AS total_records,
 coalesce(avg(CASE WHEN units_sold BETWEEN 10 AND 25 THEN predicted_revenue END), 0.0) AS filtered_avg,
 avg(predicted_revenue) AS overall_avg FROM sales)
SELECT filtered_records, total_records, round(filtered_avg, 4) AS filtered_avg, round(overall_avg, 4) AS overall_avg,
 round(filtered_avg - overall_avg, 4) AS avg_impact, round((filtered_avg / overall_avg - 1) * 100, 4) AS avg_impact_pct FROM t""",
)
def p9(spark, sf):
    return rounded(sel.range_comparison(list_price_scores(spark, sf, []), "units_sold", 10.0, 25.0))


@query(
    "p10_history_window",
    FORECAST
    + """SELECT date, round(revenue, 4) AS revenue FROM daily
WHERE date BETWEEN (SELECT min(date) FROM forecast) - 31 AND (SELECT min(date) FROM forecast) - 1""",
)
def p10(spark, sf):
    start = forecast(spark, sf).agg(F.min("date")).first()[0]  # one date
    end = start - dt.timedelta(days=1)
    recent = sel.between_dates(sales(spark, sf, []), end - dt.timedelta(days=30), end)
    return rounded(buckets.daily_series(recent))


WITH_LAG = """, lagged AS (SELECT date, revenue, lag(revenue, 1) OVER (ORDER BY date) AS revenue_lag_1,
 lag(revenue, 7) OVER (ORDER BY date) AS revenue_lag_7 FROM daily) """


@query(
    "p11_null_rows",
    DAILY + WITH_LAG + """SELECT count(*) AS rows, count(*) FILTER (WHERE revenue_lag_1 IS NULL OR revenue_lag_7 IS NULL)
 AS rows_with_null FROM lagged""",
)
def p11(spark, sf):
    daily = buckets.daily_series(sales(spark, sf, []))
    return sel.null_row_count(windows.series_lag_rolling(daily, "revenue", (1, 7), ()))


@query(
    "p11_drop_null_rows",
    DAILY
    + WITH_LAG
    + """SELECT date, round(revenue, 4) AS revenue, round(revenue_lag_1, 4) AS revenue_lag_1,
 round(revenue_lag_7, 4) AS revenue_lag_7 FROM lagged WHERE revenue_lag_7 IS NOT NULL""",
)
def p11_drop(spark, sf):
    daily = buckets.daily_series(sales(spark, sf, []))
    return rounded(sel.drop_null_rows(windows.series_lag_rolling(daily, "revenue", (1, 7), ())))


@query("p12_distinct_values", SALES + "SELECT DISTINCT category FROM sales")
def p12(spark, sf):
    return sel.distinct_values(sales(spark, sf, ["category"]), "category")


@query(
    "p13_preview",
    SALES + f"SELECT {KEY_SQL}, round(revenue, 6) AS revenue FROM sales ORDER BY {KEY_SQL} LIMIT 5",
)
def p13(spark, sf):
    return rounded(sel.preview(sales(spark, sf, []).select(*KEYS, "revenue"), KEYS), {"revenue": 6})


@query(
    "p14_rename",
    SALES + 'SELECT transaction_date AS "Date", units_sold AS "Units_Sold" FROM sales',
)
def p14(spark, sf):
    df = sales(spark, sf, []).select("transaction_date", "units_sold")
    return sel.rename(df, {"transaction_date": "Date", "units_sold": "Units_Sold"})


# --- alignments ------------------------------------------------------------------------


@query(
    "j2_align_actuals",
    SALES
    + """, p AS (SELECT l_orderkey, count(*) AS rows, sum(predicted_revenue) AS predicted FROM sales
  WHERE units_sold > 25 GROUP BY 1),
a AS (SELECT l_orderkey, sum(revenue) AS actual FROM sales GROUP BY 1)
SELECT l_orderkey, round(actual, 4) AS actual, round(predicted, 4) AS predicted, rows FROM a JOIN p USING (l_orderkey)""",
)
def j2(spark, sf):
    scored = list_price_scores(spark, sf, [])
    predictions = scored.filter("units_sold > 25").groupBy("l_orderkey")
    predictions = predictions.agg(F.count("*").alias("rows"), F.sum("predicted_revenue").alias("predicted"))
    actuals = sales(spark, sf, []).groupBy("l_orderkey").agg(F.sum("revenue").alias("actual"))
    return rounded(align.align_by_key(actuals, predictions, ["l_orderkey"]))


@query(
    "j3_inputs_with_predictions",
    SALES + "SELECT discount_applied AS feature_value, round(predicted_revenue, 6) AS predicted_revenue FROM sales",
)
def j3(spark, sf):
    df = list_price_scores(spark, sf, [])
    return rounded(df.select(F.col("discount_applied").alias("feature_value"), "predicted_revenue"), 6)


DAY_DIM = """, dim AS (SELECT * FROM (VALUES (0,'Monday'),(1,'Tuesday'),(2,'Wednesday'),(3,'Thursday'),(4,'Friday'),
 (5,'Saturday'),(6,'Sunday')) v(day_position, day_of_week)) """


@query(
    "j4_day_order",
    SALES
    + DAY_DIM
    + """SELECT day_of_week, CAST(day_position AS INTEGER) AS day_position, round(revenue, 4) AS revenue FROM dim
LEFT JOIN (SELECT dayname(transaction_date) AS day_of_week, avg(revenue) AS revenue FROM sales
 WHERE transaction_date BETWEEN DATE '1997-01-01' AND DATE '1997-01-04' GROUP BY 1) USING (day_of_week)""",
)
def j4(spark, sf):
    few = sel.between_dates(sales(spark, sf, []), dt.date(1997, 1, 1), dt.date(1997, 1, 4))
    means = few.groupBy(cal.day_name("transaction_date").alias("day_of_week")).agg(F.avg("revenue").alias("revenue"))
    return rounded(align.in_day_order(means))


@query(
    "j5_gap_fill_series",
    SALES
    + """, m AS (SELECT category, region, transaction_date AS date, sum(revenue) AS revenue FROM sales GROUP BY 1, 2, 3),
e AS (SELECT category, region, min(date) AS lo, max(date) AS hi FROM m GROUP BY 1, 2),
s AS (SELECT category, region, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM e)
SELECT category, region, date, round(coalesce(revenue, 0.0), 4) AS revenue FROM s LEFT JOIN m USING (category, region, date)""",
)
def j5(spark, sf):
    df = sales(spark, sf, ["category", "region"])
    return rounded(buckets.daily_series(df, by=["category", "region"]))


@query(
    "j6_segment_comparison",
    SALES
    + """, ca AS (SELECT category, avg(revenue) AS a FROM sales GROUP BY 1), ra AS (SELECT region, avg(revenue) AS a FROM sales GROUP BY 1)
SELECT l_orderkey, l_linenumber, category, region, round(predicted_revenue, 4) AS predicted_revenue,
 round(ca.a, 2) AS category_average, round((predicted_revenue - ca.a) / ca.a * 100, 2) AS category_diff_pct,
 round(ra.a, 2) AS region_average, round((predicted_revenue - ra.a) / ra.a * 100, 2) AS region_diff_pct,
 round(o.a, 2) AS overall_average, round((predicted_revenue - o.a) / o.a * 100, 2) AS overall_diff_pct
FROM sales JOIN ca USING (category) JOIN ra USING (region) CROSS JOIN (SELECT avg(revenue) AS a FROM sales) o""",
)
def j6(spark, sf):
    scored = list_price_scores(spark, sf).select(
        "l_orderkey", "l_linenumber", "category", "region", "predicted_revenue"
    )
    out = align.compare_to_segments(scored, sales(spark, sf))
    digits = {c: 2 for c in out.columns if c.endswith(("_average", "_pct"))}
    return rounded(out, {**digits, "predicted_revenue": 4})


# --- aggregations ----------------------------------------------------------------------


@query(
    "a1_kpis",
    SALES
    + """SELECT round(sum(revenue), 4) AS total_revenue, count(*) AS num_transactions, round(avg(revenue), 4) AS avg_revenue,
 count(DISTINCT category) AS num_category, count(DISTINCT region) AS num_region FROM sales""",
)
def a1(spark, sf):
    return rounded(agg.kpis(sales(spark, sf)), 4)


@query(
    "a2_prediction_kpis",
    SALES
    + """SELECT round(sum(predicted_revenue), 4) AS total, round(avg(predicted_revenue), 4) AS average,
 round(max(predicted_revenue), 4) AS maximum, count(predicted_revenue) AS predictions FROM sales""",
)
def a2(spark, sf):
    return rounded(
        agg.prediction_kpis(list_price_scores(spark, sf, [])), 4
    )


@query(
    "a3_forecast_kpis",
    FORECAST
    + """SELECT round(sum(predicted_revenue), 4) AS total, round(avg(predicted_revenue), 4) AS average,
 round(max(predicted_revenue), 4) AS maximum, round(min(predicted_revenue), 4) AS minimum,
 CAST(max(date) - min(date) + 1 AS INTEGER) AS period_days FROM forecast""",
)
def a3(spark, sf):
    return rounded(agg.forecast_kpis(forecast(spark, sf)))


@query("a4_revenue_by_category", SALES + "SELECT category, round(sum(revenue), 4) AS revenue FROM sales GROUP BY 1 ORDER BY 2")
def a4(spark, sf):
    df = agg.total_by(sales(spark, sf, ["category"]), ["category"])
    return rounded(sel.sort_by_measure(df, "revenue", ["category"], ascending=True))


@query("a5_revenue_by_region", SALES + "SELECT region, round(sum(revenue), 4) AS revenue FROM sales GROUP BY 1")
def a5(spark, sf):
    return rounded(agg.total_by(sales(spark, sf, ["region"]), ["region"]))


@query(
    "a6_category_totals",
    SALES + "SELECT category, round(sum(revenue), 4) AS revenue, count(*) AS transaction_count FROM sales GROUP BY 1 ORDER BY 2 DESC",
)
def a6(spark, sf):
    df = agg.total_and_count_by(sales(spark, sf, ["category"]), ["category"])
    return rounded(sel.sort_by_measure(df, "revenue", ["category"]))


@query(
    "a7_region_average_value",
    SALES
    + """SELECT region, round(sum(revenue), 4) AS revenue, count(*) AS transaction_count,
 round(sum(revenue) / count(*), 4) AS avg_transaction_value FROM sales GROUP BY 1""",
)
def a7(spark, sf):
    return rounded(agg.average_transaction_by(sales(spark, sf, ["region"]), ["region"]))


@query(
    "a8_category_region_totals",
    SALES + "SELECT category, region, round(sum(revenue), 4) AS revenue FROM sales GROUP BY 1, 2",
)
def a8(spark, sf):
    return rounded(agg.total_by(sales(spark, sf), ["category", "region"]))


@query(
    "a8_category_region_cube",
    SALES + "SELECT category, region, round(sum(revenue), 4) AS revenue FROM sales GROUP BY CUBE (category, region)",
)
def a8_cube(spark, sf):
    return rounded(agg.total_rollup(sales(spark, sf), ["category", "region"]))


@query(
    "a9_category_region_means",
    SALES
    + "SELECT category, "
    + ", ".join(f"""round(coalesce(avg(revenue) FILTER (WHERE region = '{r}'), 0.0), 4) AS "{r}" """ for r in REGIONS)
    + " FROM sales GROUP BY category",
)
def a9(spark, sf):
    return rounded(agg.matrix(sales(spark, sf), "category", "region", REGIONS, fill=0.0))


@query(
    "a10_weekday_month_matrix",
    SALES
    + "SELECT dayname(transaction_date) AS day_of_week, "
    + ", ".join(f"""round(sum(revenue) FILTER (WHERE month(transaction_date) = {m}), 4) AS "{m}" """ for m in range(1, 13))
    + " FROM sales GROUP BY 1",
)
def a10(spark, sf):
    df = sales(spark, sf, []).select(
        cal.day_name("transaction_date").alias("day_of_week"), F.month("transaction_date").alias("month"), "revenue"
    )
    return rounded(agg.matrix(df, "day_of_week", "month", range(1, 13), how="sum"))


@query(
    "a11_units_by_region_month",
    SALES
    + """, g AS (SELECT region, month(transaction_date) AS month, avg(units_sold) AS mean, stddev_samp(units_sold) AS sd,
 count(units_sold) AS n FROM sales GROUP BY 1, 2)
SELECT region, CAST(month AS INTEGER) AS month, round(mean, 4) AS mean, round(sd, 4) AS sd, n,
 round(mean - 1.96 * sd / sqrt(n), 4) AS lower, round(mean + 1.96 * sd / sqrt(n), 4) AS upper FROM g""",
)
def a11(spark, sf):
    df = sales(spark, sf, ["region"])
    keys = ["region", F.month("transaction_date").alias("month")]
    return rounded(agg.mean_with_interval(df, keys, "units_sold"))


@query(
    "a12_value_counts",
    SALES + "SELECT category, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM sales GROUP BY 1",
)
def a12(spark, sf):
    return rounded(agg.value_counts(sales(spark, sf, ["category"]), "category"), 6)


@query(
    "a13_predicted_by_segment",
    SALES
    + """SELECT category, region, round(sum(predicted_revenue), 4) AS predicted_revenue FROM sales
GROUP BY 1, 2 ORDER BY 3 DESC""",
)
def a13(spark, sf):
    df = agg.total_by(list_price_scores(spark, sf), ["category", "region"], "predicted_revenue")
    return rounded(sel.sort_by_measure(df, "predicted_revenue", ["category", "region"]))


@query("a14_rows_by_segment", SALES + "SELECT region, count(*) AS count FROM sales GROUP BY 1")
def a14(spark, sf):
    return agg.count_by(sales(spark, sf, ["region"]), ["region"])


@query(
    "a15_predicted_by_date",
    SALES + "SELECT transaction_date AS date, round(sum(predicted_revenue), 4) AS predicted_revenue FROM sales GROUP BY 1",
)
def a15(spark, sf):
    df = list_price_scores(spark, sf, []).withColumnRenamed("transaction_date", "date")
    return rounded(agg.total_by(df, ["date"], "predicted_revenue"))


@query(
    "a16_statistics_by_value",
    SALES
    + """SELECT category AS feature_value, round(avg(predicted_revenue), 4) AS mean, round(median(predicted_revenue), 6) AS median,
 count(*) AS count, round(stddev_samp(predicted_revenue), 4) AS std FROM sales GROUP BY 1 ORDER BY 2 DESC""",
)
def a16(spark, sf):
    df = agg.group_statistics(list_price_scores(spark, sf, ["category"]), "category")
    return rounded(sel.sort_by_measure(df, "mean", ["feature_value"]), {"mean": 4, "median": 6, "std": 4})


@query(
    "a17_spread_ratio",
    SALES
    + """, g AS (SELECT category, stddev_samp(predicted_revenue) AS sd FROM sales GROUP BY 1)
SELECT round(m, 4) AS mean_group_std, round(s, 4) AS overall_std, round(m / s, 6) AS ratio
FROM (SELECT avg(sd) AS m FROM g), (SELECT stddev_samp(predicted_revenue) AS s FROM sales)""",
)
def a17(spark, sf):
    df = agg.spread_ratio(list_price_scores(spark, sf, ["category"]), "category")
    return rounded(df, {"mean_group_std": 4, "overall_std": 4, "ratio": 6})


@query(
    "a18_monthly_forecast",
    FORECAST
    + """SELECT CAST(date_trunc('month', date) AS DATE) AS month, round(sum(predicted_revenue), 4) AS total,
 round(avg(predicted_revenue), 4) AS average, round(stddev_samp(predicted_revenue), 4) AS std, count(*) AS days
FROM forecast GROUP BY 1""",
)
def a18(spark, sf):
    return rounded(yardstick.monthly_summary(forecast(spark, sf)))


@query(
    "a19_mean_by_weekday",
    FORECAST
    + DAY_DIM
    + """SELECT day_of_week, CAST(day_position AS INTEGER) AS day_position, round(predicted_revenue, 4) AS predicted_revenue
FROM dim LEFT JOIN (SELECT dayname(date) AS day_of_week, avg(predicted_revenue) AS predicted_revenue FROM forecast GROUP BY 1)
USING (day_of_week)""",
)
def a19(spark, sf):
    f = forecast(spark, sf).groupBy(cal.day_name("date").alias("day_of_week"))
    return rounded(align.in_day_order(f.agg(F.avg("predicted_revenue").alias("predicted_revenue"))))


@query(
    "a20_feature_summary",
    SALES
    + """, u AS (SELECT 'units_sold' AS feature, 'Numeric' AS type, count(DISTINCT units_sold) AS unique_values,
   abs(corr(units_sold, predicted_revenue)) AS s FROM sales
 UNION ALL SELECT 'discount_applied', 'Numeric', count(DISTINCT discount_applied), abs(corr(discount_applied, predicted_revenue)) FROM sales
 UNION ALL SELECT 'clicks', 'Numeric', count(DISTINCT clicks), abs(corr(clicks, predicted_revenue)) FROM sales
 UNION ALL SELECT 'category', 'Categorical', count(DISTINCT category), greatest(0.1, least(0.9, 1 -
   (SELECT avg(sd) FROM (SELECT stddev_samp(predicted_revenue) AS sd FROM sales GROUP BY category)) / stddev_samp(predicted_revenue))) FROM sales)
SELECT feature, type, unique_values, round(s / sum(s) OVER (), 6) AS importance,
 CASE WHEN s / sum(s) OVER () > 0.15 THEN 'High' WHEN s / sum(s) OVER () > 0.05 THEN 'Medium' ELSE 'Low' END AS impact_level
FROM u""",
)
def a20(spark, sf):
    from demandlens.operators.importance import data_driven_importance

    df = list_price_scores(spark, sf, ["category", "clicks"])
    numeric, text = ["units_sold", "discount_applied", "clicks"], ["category"]
    scores = data_driven_importance(df, numeric, text)
    out = agg.feature_summary(df, numeric, text).join(scores, "feature")
    return rounded(out.withColumn("impact_level", agg.impact_level(F.col("importance"))), {"importance": 6})


@query(
    "a21_duplicate_rows",
    """SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
 AS duplicate_rows FROM lineitem""",
)
def a21(spark, sf):
    return agg.duplicate_rows(sales(spark, sf, []).select("l_orderkey", "l_linenumber"))


@query(
    "a22_numeric_profile",
    SALES
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
 round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(quantile_cont({c}, 0.25), 6) AS q1,
 round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3 FROM sales"""
        for c in ("units_sold", "discount_applied", "revenue")
    ),
)
def a22(spark, sf):
    out = distribution.numeric_profile(sales(spark, sf, []), ["units_sold", "discount_applied", "revenue"])
    return rounded(out, {"mean": 4, "std": 4, "min": 4, "max": 4, "q1": 6, "median": 6, "q3": 6})


@query(
    "a22_text_profile",
    SALES
    + " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS "column", (SELECT count({c}) FROM sales) AS count,
 (SELECT count(DISTINCT {c}) FROM sales) AS "unique", CAST({c} AS VARCHAR) AS top, count(*) AS freq
 FROM sales GROUP BY {c} ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 1)"""
        for c in ("category", "region", "transaction_date")
    ),
)
def a22_text(spark, sf):
    return distribution.text_profile(sales(spark, sf), ["category", "region", "transaction_date"])


@query(
    "a23_null_counts",
    SALES
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls FROM sales"""
        for c in ("transaction_date", "category", "region", *NUMERIC)
    ),
)
def a23(spark, sf):
    df = sales(spark, sf, ["category", "region", *AD_COLUMNS])
    return agg.null_counts(df.select("transaction_date", "category", "region", *NUMERIC))


@query("a23_shape", "SELECT count(*) AS rows, CAST(11 AS INTEGER) AS columns FROM lineitem")
def a23_shape(spark, sf):
    return agg.shape(sales(spark, sf, []))


@query(
    "a24_exact_quartiles",
    SALES
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(p AS DOUBLE) AS probability, round(q, 6) AS quantile FROM
 (SELECT unnest([0.25, 0.5, 0.75]) AS p, unnest(quantile_cont({c}, [0.25, 0.5, 0.75])) AS q FROM sales)"""
        for c in NUMERIC
    ),
)
def a24(spark, sf):
    from demandlens.operators.quantiles import exact_quantiles

    df = stage(sales(spark, sf, AD_COLUMNS).select(NUMERIC))  # read three times
    return rounded(exact_quantiles(df, NUMERIC, [0.25, 0.5, 0.75]), {"quantile": 6})


@query(
    "a25_correlation_pairs",
    SALES
    + " UNION ALL ".join(
        f"""SELECT '{a}' AS "left", '{b}' AS "right", round(corr({a}, {b}), 6) AS r FROM sales"""
        for i, a in enumerate(NUMERIC)
        for b in NUMERIC[i + 1 :]
    ),
)
def a25(spark, sf):
    return rounded(agg.correlation_pairs(sales(spark, sf, AD_COLUMNS), NUMERIC), 6)


@query(
    "a25_correlation_matrix",
    SALES
    + " UNION ALL ".join(
        f"""SELECT '{a}' AS "column", """
        + ", ".join(f'round(corr({a}, {b}), 6) AS {b}' for b in NUMERIC[:4])
        + " FROM sales"
        for a in NUMERIC[:4]
    ),
)
def a25_matrix(spark, sf):
    return rounded(agg.correlation_matrix(sales(spark, sf, AD_COLUMNS), NUMERIC[:4]), 6)


HIST = """, e AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
b AS (SELECT CAST(least(floor((x - lo) / (hi - lo) * {bins}), {bins} - 1) AS INTEGER) AS bin, sub, lo, hi FROM v, e)
SELECT bin, round(min(lo) + bin * (min(hi) - min(lo)) / {bins}, 4) AS bin_start, count(*) AS count,
 round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent"""


@query(
    "a26_histogram",
    SALES + ", v AS (SELECT revenue AS x, true AS sub FROM sales)" + HIST.format(bins=30) + " FROM b GROUP BY bin",
)
def a26(spark, sf):
    return rounded(distribution.histogram(sales(spark, sf, [])), {"bin_start": 4, "percent": 6})


@query(
    "a26_histogram_subset",
    SALES
    + ", v AS (SELECT predicted_revenue AS x, units_sold BETWEEN 10 AND 25 AS sub FROM sales)"
    + HIST.format(bins=30)
    + """, count(*) FILTER (WHERE sub) AS subset_count,
 round(count(*) FILTER (WHERE sub) * 100.0 / sum(count(*) FILTER (WHERE sub)) OVER (), 6) AS subset_percent FROM b GROUP BY bin""",
)
def a26_subset(spark, sf):
    df = list_price_scores(spark, sf, [])
    out = distribution.histogram(df, "predicted_revenue", 30, F.col("units_sold").between(10.0, 25.0))
    return rounded(out, {"bin_start": 4, "percent": 6, "subset_percent": 6})


@query(
    "a26_automatic_bins",
    SALES
    + """, s AS (SELECT count(revenue) AS n, quantile_cont(revenue, 0.75) - quantile_cont(revenue, 0.25) AS iqr,
 max(revenue) - min(revenue) AS span FROM sales),
w AS (SELECT *, least(2 * iqr / cbrt(n), span / (log2(n) + 1)) AS width FROM s)
SELECT n, round(iqr, 6) AS iqr, round(width, 4) AS width, CAST(ceil(span / width) AS INTEGER) AS bins FROM w""",
)
def a26_auto(spark, sf):
    return rounded(distribution.automatic_bins(sales(spark, sf, [])), {"iqr": 6, "width": 4})


BOX_DIGITS = {"q1": 6, "median": 6, "q3": 6, "whisker_low": 4, "whisker_high": 4}
BOX = """, q AS (SELECT {k}, quantile_cont(revenue, 0.25) AS q1, quantile_cont(revenue, 0.5) AS median,
 quantile_cont(revenue, 0.75) AS q3 FROM sales GROUP BY 1),
f AS (SELECT s.{k}, q1, median, q3, revenue, revenue BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok
 FROM sales s JOIN q USING ({k}))
SELECT {k}, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
 round(min(revenue) FILTER (WHERE ok), 4) AS whisker_low, round(max(revenue) FILTER (WHERE ok), 4) AS whisker_high,
 count(*) FILTER (WHERE NOT ok) AS outliers, count(*) AS n FROM f GROUP BY {k}, q1, median, q3"""


@query("a27_box_by_category", SALES + BOX.format(k="category"))
def a27(spark, sf):
    return rounded(distribution.box_statistics(sales(spark, sf, ["category"]), "category"), BOX_DIGITS)


@query("a27_box_by_region", SALES + BOX.format(k="region"))
def a27_region(spark, sf):
    return rounded(distribution.box_statistics(sales(spark, sf, ["region"]), "region"), BOX_DIGITS)


@query(
    "a28_trend_line",
    SALES
    + """SELECT round(regr_slope(predicted_revenue, units_sold), 6) AS slope,
 round(regr_intercept(predicted_revenue, units_sold), 4) AS intercept, round(regr_r2(predicted_revenue, units_sold), 6) AS r2,
 CAST(regr_count(predicted_revenue, units_sold) AS BIGINT) AS n FROM sales""",
)
def a28(spark, sf):
    out = agg.trend_line(list_price_scores(spark, sf, []), "units_sold", "predicted_revenue")
    return rounded(out, {"slope": 6, "intercept": 4, "r2": 6})


@query(
    "a29_bounds",
    SALES
    + """SELECT min(units_sold) AS min_units_sold, min(transaction_date) AS min_transaction_date,
 max(units_sold) AS max_units_sold, max(transaction_date) AS max_transaction_date FROM sales""",
)
def a29(spark, sf):
    return agg.bounds(sales(spark, sf, []), ["units_sold", "transaction_date"])


@query(
    "a30_extreme_dates",
    FORECAST
    + """SELECT (SELECT date FROM forecast ORDER BY predicted_revenue DESC, date LIMIT 1) AS max_date,
 round(max(predicted_revenue), 4) AS max_value,
 (SELECT date FROM forecast ORDER BY predicted_revenue, date LIMIT 1) AS min_date,
 round(min(predicted_revenue), 4) AS min_value FROM forecast""",
)
def a30(spark, sf):
    return rounded(agg.extreme_dates(forecast(spark, sf)))


# --- sorts and limits ------------------------------------------------------------------


@query(
    "l1_sort_by_date",
    SALES + f"SELECT {KEY_SQL} FROM sales ORDER BY {KEY_SQL}",
)
def l1(spark, sf):
    return sales(spark, sf, []).select(KEYS).orderBy(*KEYS)


@query(
    "l2_sort_by_measure",
    SALES + "SELECT product_id, round(sum(revenue), 4) AS revenue FROM sales GROUP BY 1 ORDER BY 2 DESC, 1",
)
def l2(spark, sf):
    df = agg.total_by(sales(spark, sf, []), ["product_id"])
    return rounded(sel.sort_by_measure(df, "revenue", ["product_id"]))


@query(
    "l3_sort_by_magnitude",
    SALES
    + """SELECT transaction_date, round(sum(revenue - predicted_revenue), 4) AS residual FROM sales GROUP BY 1
ORDER BY abs(sum(revenue - predicted_revenue)), 1""",
)
def l3(spark, sf):
    df = list_price_scores(spark, sf, []).withColumn("residual", F.col("revenue") - F.col("predicted_revenue"))
    return rounded(sel.sort_by_magnitude(agg.total_by(df, ["transaction_date"], "residual"), "residual", ["transaction_date"]))


SAMPLE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(
    "l4_seeded_sample",
    SALES
    + f"""SELECT {', '.join(SAMPLE_KEYS)}, units_sold FROM sales
ORDER BY md5(concat_ws('|', '42', {', '.join(f'CAST({k} AS VARCHAR)' for k in SAMPLE_KEYS)})), {', '.join(SAMPLE_KEYS)} LIMIT 100""",
)
def l4(spark, sf):
    return sel.seeded_sample(sales(spark, sf, []).select(*SAMPLE_KEYS, "units_sold"), SAMPLE_KEYS)


@query(
    "l5_top_correlated_features",
    SALES
    + "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(abs(corr({c}, predicted_revenue)), 6) AS r FROM sales" for c in NUMERIC
    )
    + ") ORDER BY r DESC, feature LIMIT 10",
)
def l5(spark, sf):
    found = agg.pair_correlations(list_price_scores(spark, sf, AD_COLUMNS), [(c, "predicted_revenue") for c in NUMERIC])
    scores = found.select(F.col("left").alias("feature"), F.abs("r").alias("r"))
    return rounded(sel.sort_by_measure(scores, "r", ["feature"]).limit(10), 6)


# --- scalar functions ------------------------------------------------------------------


@query(
    "f_math_scalars",
    SALES
    + """SELECT l_orderkey, l_linenumber, l_partkey, round_even(revenue * 100, 0) / 100 AS rounded,
 round(ln(1 + greatest(revenue, 0.0)), 6) AS logged, round(greatest(exp(ln(1 + revenue)) - 1, 0.0), 4) AS restored,
 round(abs(revenue - predicted_revenue), 4) AS absolute, round(sqrt(revenue), 6) AS root,
 round(greatest(revenue - predicted_revenue, 0.0), 4) AS clipped, greatest(0.1::DOUBLE, least(0.9::DOUBLE, discount_applied * 10)) AS clamped,
 round(CASE WHEN predicted_revenue > 0 THEN (revenue - predicted_revenue) / predicted_revenue * 100 ELSE 0.0 END, 4) AS pct,
 TRY_CAST(CASE WHEN l_orderkey % 2 = 0 THEN 'n/a' ELSE CAST(l_quantity AS VARCHAR) END AS DOUBLE) AS parsed FROM sales""",
)
def f_math(spark, sf):
    df = list_price_scores(spark, sf, [])
    gap = F.col("revenue") - F.col("predicted_revenue")
    text = F.when(F.col("l_orderkey") % 2 == 0, "n/a").otherwise(F.col("l_quantity").cast("string"))
    return df.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        num.round_half_even("revenue").alias("rounded"),
        num.round_half_away(num.log1p_clamped("revenue"), 6).alias("logged"),
        num.round_half_away(num.expm1_clamped(num.log1p_clamped("revenue")), 4).alias("restored"),
        num.round_half_away(F.abs(gap), 4).alias("absolute"),
        num.round_half_away(F.sqrt("revenue"), 6).alias("root"),
        num.round_half_away(num.clip_low(gap), 4).alias("clipped"),
        num.clamp(F.col("discount_applied") * 10, 0.1, 0.9).alias("clamped"),
        num.round_half_away(num.percent_difference("revenue", "predicted_revenue"), 4).alias("pct"),
        num.to_number(text).alias("parsed"),
    )


@query(
    "f_date_scalars",
    """SELECT DISTINCT CAST(l_shipdate AS DATE) AS date, CAST(month(l_shipdate) AS INTEGER) AS month,
 CAST(isodow(l_shipdate) - 1 AS INTEGER) AS dayofweek, CAST(weekofyear(l_shipdate) AS INTEGER) AS weekofyear,
 CAST(quarter(l_shipdate) AS INTEGER) AS quarter, CAST(isodow(l_shipdate) IN (6, 7) AS INTEGER) AS is_weekend,
 CAST(CAST(l_shipdate AS DATE) IN (DATE '2024-04-10', DATE '2024-06-16') AS INTEGER) AS is_holiday,
 CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 'winter' WHEN month(l_shipdate) <= 5 THEN 'spring'
      WHEN month(l_shipdate) <= 8 THEN 'summer' ELSE 'autumn' END AS season,
 dayname(l_shipdate) AS day_name, strftime(l_shipdate, '%B %Y') AS month_label, strftime(l_shipdate, '%Y-%m-%d') AS iso,
 CAST(l_shipdate AS DATE) + 30 AS plus_30, CAST(l_shipdate AS DATE) - 30 AS minus_30 FROM lineitem""",
)
def f_date(spark, sf):
    d = F.col("date")
    days = sales(spark, sf, []).select(F.col("transaction_date").alias("date")).distinct()
    return days.select(
        d,
        F.month(d).alias("month"),
        cal.day_of_week(d).alias("dayofweek"),
        F.weekofyear(d).alias("weekofyear"),
        F.quarter(d).alias("quarter"),
        cal.is_weekend(d).alias("is_weekend"),
        cal.is_holiday(d).alias("is_holiday"),
        cal.season(d).alias("season"),
        cal.day_name(d).alias("day_name"),
        cal.month_label(d).alias("month_label"),
        F.date_format(d, "yyyy-MM-dd").alias("iso"),
        F.date_add(d, 30).alias("plus_30"),
        F.date_sub(d, 30).alias("minus_30"),
    )


@query(
    "f_str_currency",
    SALES
    + """SELECT region, '$' || format('{:,.2f}', sum(revenue)) AS revenue FROM sales GROUP BY 1""",
)
def f_str(spark, sf):
    df = agg.total_by(sales(spark, sf, ["region"]), ["region"])
    return df.select("region", num.currency("revenue").alias("revenue"))
