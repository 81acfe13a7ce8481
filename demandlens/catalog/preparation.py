"""Fitted feature preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandlens.catalog.base import NUMBERED, SALES, query, rounded
from demandlens.catalog.descriptive import NUMERIC
from demandlens.functions import calendar as cal
from demandlens.operators import features as fp
from demandlens.operators import select as sel
from demandlens.operators import windows
from demandlens.session import stage
from demandlens.sources.star import AD_COLUMNS, ORDER_KEYS, REGIONS, sales

CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
FLAGS_SQL = ", ".join(
    f"""CAST({c} = '{v}' AS DOUBLE) AS "{c}_{v}" """
    for c, vs in (("category", CATEGORIES), ("region", REGIONS))
    for v in vs
)
IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
ID_SQL = ", ".join(IDS)
WANTED = ["category", "region", *AD_COLUMNS]


@query(
    "j1_encoded_columns",
    SALES
    + """SELECT category, region, CAST(region = 'ASIA' AS DOUBLE) AS "region_ASIA", CAST(category = 'PROMO' AS DOUBLE) AS "category_PROMO",
 count(*) AS n FROM sales GROUP BY ALL""",
)
def j1(spark, sf):
    df = sales(spark, sf)
    encoded = df.withColumns(fp.one_hot({"region": ["ASIA"], "category": ["PROMO"]}))
    return encoded.groupBy("category", "region", "region_ASIA", "category_PROMO").agg(F.count("*").alias("n"))


@query(
    "f2_correlated_columns",
    SALES
    + "SELECT \"column\", round(max(r), 6) AS max_r FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{b}' AS "column", corr({a}, {b}) AS r FROM sales"""
        for i, a in enumerate(NUMERIC)
        for b in NUMERIC[i + 1 :]
    )
    + ") WHERE r > 0.8 GROUP BY 1",
)
def f2(spark, sf):
    return rounded(fp.correlated_columns(sales(spark, sf, AD_COLUMNS), NUMERIC), 6)


@query("f3_one_hot", SALES + f"SELECT {ID_SQL}, {FLAGS_SQL} FROM sales")
def f3(spark, sf):
    df = sales(spark, sf)
    flags = fp.one_hot(fp.fit_categories(df))
    return df.select(*IDS, *[c.alias(n) for n, c in flags.items()])


@query(
    "f3_unseen_values",
    SALES + """SELECT 'region' AS "column", region AS value, count(*) AS rows FROM sales WHERE region = 'ASIA' GROUP BY 2""",
)
def f3_unseen(spark, sf):
    df = sales(spark, sf)
    return fp.unseen_values(df, fp.fit_categories(df.filter("region <> 'ASIA'")))


@query(
    "f4_season_flags",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(month(l_shipdate) IN (3, 4, 5) AS INTEGER) AS season_spring,
 CAST(month(l_shipdate) IN (6, 7, 8) AS INTEGER) AS season_summer,
 CAST(month(l_shipdate) IN (12, 1, 2) AS INTEGER) AS season_winter FROM lineitem""",
)
def f4(spark, sf):
    df = sales(spark, sf, [])
    flags = cal.season_flags("transaction_date")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", *[c.alias(n) for n, c in flags.items()])


TREATED = ["discount_applied", "clicks", "conversion_rate", "ad_cpc", "ad_spend"]


def _fences(columns, source):
    return ", ".join(
        f"""quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c},
 quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}, median({c}) AS med_{c}"""
        for c in columns
    ) + f" FROM {source}"


def _treated(c):
    return f"CASE WHEN {c} < lo_{c} OR {c} > hi_{c} THEN med_{c} ELSE {c} END"


@query(
    "f5_outlier_limits",
    SALES
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(q1, 6) AS q1, round(m, 6) AS median, round(q3, 6) AS q3,
 round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper FROM (SELECT
 quantile_cont({c}, 0.25) AS q1, median({c}) AS m, quantile_cont({c}, 0.75) AS q3 FROM sales)"""
        for c in TREATED
    ),
)
def f5_limits(spark, sf):
    return rounded(fp.outlier_limits(stage(sales(spark, sf, AD_COLUMNS).select(TREATED)), TREATED), 6)


@query(
    "f5_outliers_to_median",
    SALES
    + f", q AS (SELECT {_fences(TREATED, 'sales')}) SELECT {ID_SQL}, "
    + ", ".join(f"round({_treated(c)}, 6) AS {c}" for c in TREATED)
    + " FROM sales, q",
)
def f5(spark, sf):
    df = stage(sales(spark, sf, AD_COLUMNS).select(*IDS, *TREATED))
    out = df.withColumns(fp.replace_outliers(fp.fit_outliers(df, TREATED)))
    return rounded(out, 6)


SCALED = ["discount_applied", "clicks", "impressions", "ad_ctr", "ad_cpc"]


@query(
    "f6_min_max",
    SALES
    + f"SELECT {ID_SQL}, "
    + ", ".join(f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}" for c in SCALED)
    + " FROM sales",
)
def f6(spark, sf):
    df = sales(spark, sf, AD_COLUMNS)
    scaled = fp.scale_ranges(fp.fit_ranges(df, SCALED))
    return rounded(df.select(*IDS, *[c.alias(n) for n, c in scaled.items()]), 6)


@query(
    "f7_calendar_features",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(month(l_shipdate) AS INTEGER) AS month,
 CAST(isodow(l_shipdate) - 1 AS INTEGER) AS dayofweek, CAST(weekofyear(l_shipdate) AS INTEGER) AS weekofyear,
 CAST(quarter(l_shipdate) AS INTEGER) AS quarter, CAST(isodow(l_shipdate) IN (6, 7) AS INTEGER) AS is_weekend,
 CAST(CAST(l_shipdate AS DATE) IN (DATE '2024-04-10', DATE '2024-06-16') AS INTEGER) AS is_holiday,
 CAST(month(l_shipdate) IN (3, 4, 5) AS INTEGER) AS season_spring, CAST(month(l_shipdate) IN (6, 7, 8) AS INTEGER) AS season_summer,
 CAST(month(l_shipdate) IN (12, 1, 2) AS INTEGER) AS season_winter FROM lineitem""",
)
def f7(spark, sf):
    df = fp.add_calendar(sales(spark, sf, []))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", *cal.calendar_features("transaction_date"))


def _lag_roll_sql() -> str:
    pairs = (("revenue", "revenue"), ("units", "units_sold"))
    parts = [f"round(lag({c}, {k}) OVER (ORDER BY rn), 6) AS {m}_lag_{k}" for k in windows.LAGS for m, c in pairs]
    parts += [
        f"round(avg({c}) OVER (ORDER BY rn ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), 6) AS {m}_rollmean_{w}"
        for w in windows.ROLLS
        for m, c in pairs
    ]
    return ", ".join(parts)


@query("f9_lag_rolling", NUMBERED + f"SELECT * FROM (SELECT rn, {_lag_roll_sql()} FROM numbered) WHERE rn > 30")
def f9(spark, sf):
    df = sales(spark, sf, []).select(*ORDER_KEYS, "revenue", "units_sold")
    out = windows.lag_rolling(df, ORDER_KEYS, keep_row_number=True)
    names = [*windows.lag_columns(), *windows.rolling_columns()]
    return rounded(sel.drop_null_rows(out.select("rn", *names)), 6)


# --- the whole sequence ----------------------------------------------------------------

LEFT = [c for c in NUMERIC if c not in ("impressions", "ad_ctr")]
CLEAN_SQL = (
    SALES
    + f", b AS (SELECT {ID_SQL}, transaction_date, category, region, "
    + ", ".join(f"round_even({c} * 100, 0) / 100 AS {c}" for c in LEFT)
    + f" FROM sales), q AS (SELECT {_fences(TREATED, 'b')}), t AS (SELECT {ID_SQL}, transaction_date, category, region, "
    + "units_sold, revenue, "
    + ", ".join(f"{_treated(c)} AS {c}" for c in TREATED)
    + ", " + ", ".join(f"{c} AS raw_{c}" for c in TREATED)
    + " FROM b, q), e AS (SELECT "
    + ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}" for c in ("discount_applied", "clicks", "ad_cpc"))
    + " FROM t)\n"
)


def _scaled(c: str, source: str) -> str:
    if c in ("discount_applied", "clicks", "ad_cpc"):
        return f"round(({source} - min_{c}) / (max_{c} - min_{c}), 6) AS {c}"
    return f"round(ln(1 + greatest({source}, 0.0)), 6) AS {c}"


@query(
    "f1_cleaned_sales",
    CLEAN_SQL
    + f"SELECT {ID_SQL}, transaction_date, units_sold, {_scaled('revenue', 'revenue')}, "
    + ", ".join(_scaled(c, c) for c in TREATED)
    + f", {FLAGS_SQL} FROM t, e",
)
def f1(spark, sf):
    df = stage(sales(spark, sf, WANTED).select(*IDS, "transaction_date", "category", "region", *NUMERIC))
    prep = fp.fit_preparation(df, NUMERIC)
    out = fp.apply_cleaning(df, prep, NUMERIC)
    return rounded(out, {c: 6 for c in ("revenue", *TREATED)})


FEATURES = [
    "units_sold", *TREATED, *[f"category_{v}" for v in CATEGORIES], *[f"region_{v}" for v in REGIONS],
    "month", "dayofweek", "is_weekend", "revenue_lag_1",
]


@query(
    "f10_scoring_features",
    CLEAN_SQL
    + f"SELECT {', '.join(f'{c} AS in_{c}' for c in IDS)}, category AS in_category, units_sold, "
    + ", ".join(_scaled(c, f"raw_{c}") for c in TREATED)
    + f""", {FLAGS_SQL}, CAST(month(transaction_date) AS DOUBLE) AS month, CAST(isodow(transaction_date) - 1 AS DOUBLE) AS dayofweek,
 CAST(isodow(transaction_date) IN (6, 7) AS DOUBLE) AS is_weekend, CAST(0 AS DOUBLE) AS revenue_lag_1 FROM t, e""",
)
def f10(spark, sf):
    df = stage(sales(spark, sf, WANTED).select(*IDS, "transaction_date", "category", "region", *NUMERIC))
    prep = fp.fit_preparation(df, NUMERIC)
    prep.feature_columns = FEATURES
    requests = df.drop("revenue")
    out = fp.scoring_features(requests, prep, NUMERIC, keep=[*IDS, "category"])
    return rounded(out, {c: 6 for c in TREATED})
