"""Scoring with history, stored forecasts, drift, imputation, intervals and stored layouts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from demandlens.catalog.base import DAILY, NUMBERED, ROW_ORDER, SALES, query, rounded
from demandlens.operators import bootstrap, buckets, drift, forecast_store, history, impute
from demandlens.session import shared_folder, stage
from demandlens.sources import bucketed
from demandlens.sources.star import ORDER_KEYS, sales
from demandlens.streaming import jobs

IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
ID_SQL = ", ".join(IDS)
MEASURES = (("revenue", "revenue"), ("units", "units_sold"))
#: New rows are those of the last so many days.
NEW_DAYS = 90


def _lags_sql(over: str) -> str:
    lags = [f"round(lag({c}, {k}) OVER ({over}), 6) AS {m}_lag_{k}" for k in (1, 7, 14, 30) for m, c in MEASURES]
    rolls = [
        f"round(CASE WHEN count({c}) OVER ({over} ROWS {w - 1} PRECEDING) = {w} THEN avg({c}) OVER ({over} ROWS {w - 1} PRECEDING) END, 6) AS {m}_rollmean_{w}"
        for w in (7, 14, 30)
        for m, c in MEASURES
    ]
    return ", ".join([*lags, *rolls])


def _parts(spark, sf, columns=()):
    """Sales before the last days, and those of the last days."""
    df = sales(spark, sf, list(columns))
    cut = df.agg(F.date_sub(F.max("transaction_date"), NEW_DAYS)).scalar()
    return df.filter(F.col("transaction_date") <= cut), df.filter(F.col("transaction_date") > cut)


_CUT = f"transaction_date > (SELECT max(transaction_date) - {NEW_DAYS} FROM sales)"


@query("f10_lags_with_history", NUMBERED + f"SELECT * EXCLUDE (new) FROM (SELECT {ID_SQL}, {_CUT} AS new, {_lags_sql('ORDER BY rn')} FROM numbered) WHERE new")
def f10_history(spark, sf):
    """Lags of new sales over all sales, of which only the last thirty before them are read on."""
    old, new = _parts(spark, sf)
    out = history.with_history(old, new, ORDER_KEYS)
    return rounded(out.select(*IDS, *history.feature_names()), {c: 6 for c in history.feature_names()})


BY = ["region", "category"]
_SERIES = "PARTITION BY region, category ORDER BY " + ROW_ORDER


@query(
    "f10_series_lags_with_history",
    SALES + f"SELECT * EXCLUDE (new) FROM (SELECT region, category, {ID_SQL}, {_CUT} AS new, {_lags_sql(_SERIES)} FROM sales) WHERE new",
)
def f10_series(spark, sf):
    """The same within each region and category."""
    old, new = _parts(spark, sf, BY)
    out = history.with_history(old, new, ORDER_KEYS, BY)
    return rounded(out.select(*BY, *IDS, *history.feature_names()), {c: 6 for c in history.feature_names()})


@query(
    "st1_stream_lags_with_history",
    SALES + f"SELECT * EXCLUDE (new) FROM (SELECT region, category, {ID_SQL}, {_CUT} AS new, {_lags_sql(_SERIES)} FROM sales) WHERE new",
)
def st1_history(spark, sf):
    """The same on a stream of three batches, each series' last rows being its state."""
    old, new = _parts(spark, sf, BY)
    names = [*BY, *ORDER_KEYS, "revenue", "units_sold"]
    new, folder, out = stage(new.select(names), "new"), shared_folder(spark, "arriving"), shared_folder(spark, "scored")
    thirds = new.agg(F.min("transaction_date").alias("first")).first()["first"]
    for part in range(3):
        low, high = (thirds + dt.timedelta(days=NEW_DAYS // 3 * k) for k in (part, part + 1))
        some = new.filter((F.col("transaction_date") >= low) & ((F.col("transaction_date") < high) | F.lit(part == 2)))
        some.coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.read_stream(spark, folder, new.schema, maxFilesPerTrigger="1")
    lagged = history.stream_with_history(old.select(names), stream, ORDER_KEYS, BY)
    jobs.append_table(lagged, out, shared_folder(spark, "lag-state")).awaitTermination()
    rows = spark.read.schema(lagged.schema).parquet(out)
    return rounded(rows.select(*BY, *IDS, *history.feature_names()), {c: 6 for c in history.feature_names()})


# --- stored forecasts ------------------------------------------------------------------

#: Literal terms, so that SQL can follow: lags 1, 7 and 8 of differences and of errors.
AR, MA, SIGMA = (0.2, 0.1, -0.02), (-0.8, -0.9, 0.72), 1000.0
_SERIES_DAYS = (
    SALES
    + """, d0 AS (SELECT region, transaction_date AS date, sum(revenue) AS revenue FROM sales GROUP BY ALL),
ends AS (SELECT region, min(date) AS lo, max(date) AS hi FROM d0 GROUP BY 1),
days AS (SELECT region, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM ends),
daily AS (SELECT region, date, coalesce(revenue, 0.0) AS y FROM days LEFT JOIN d0 USING (region, date)),
s AS (SELECT region, list(y ORDER BY date) AS ys, min(date) AS lo, (SELECT max(hi) FROM ends) AS top FROM daily GROUP BY 1)
"""
)
_EXPECTED = " + ".join(f"{a} * w[{i}] + {m} * e[{i}]" for a, m, i in zip(AR, MA, (8, 2, 1)))
_RECURSION = f"""
SELECT region, lo, n, m FROM (
 WITH RECURSIVE r AS (
  SELECT region, lo, top, ys, 16 AS n, ys[9:16] AS y, [ys[i] - ys[i - 1] - ys[i - 7] + ys[i - 8] FOR i IN range(9, 17)] AS w,
         [0.0::DOUBLE FOR i IN range(8)] AS e, NULL::DOUBLE AS m FROM s
  UNION ALL
  SELECT region, lo, top, ys, n + 1, list_append(y[2:8], v), list_append(w[2:8], v - level), list_append(e[2:8], v - level - x), level + x
  FROM (SELECT *, CASE WHEN n < len(ys) THEN ys[n + 1] ELSE level + x END AS v
        FROM (SELECT *, y[8] + y[2] - y[1] AS level, {_EXPECTED} AS x FROM r WHERE n < top - lo + 61))
 ) SELECT * FROM r WHERE n BETWEEN top - lo - 28 AND top - lo + 61)
"""
_RESPONSE = f"""
SELECT h, sum(v * v) OVER (ORDER BY h) AS total FROM (
 WITH RECURSIVE p AS (
  SELECT 0 AS h, 0.0::DOUBLE AS v, [0.0::DOUBLE FOR i IN range(8)] AS y, [0.0::DOUBLE FOR i IN range(8)] AS w, [0.0::DOUBLE FOR i IN range(8)] AS e
  UNION ALL
  SELECT h + 1, x + shock + level, list_append(y[2:8], x + shock + level), list_append(w[2:8], x + shock), list_append(e[2:8], shock)
  FROM (SELECT *, y[8] + y[2] - y[1] AS level, {_EXPECTED} AS x, CASE WHEN h = 0 THEN 1.0 ELSE 0.0 END AS shock FROM p WHERE h < 150)
 ) SELECT * FROM p WHERE h > 0)
"""


@query(
    "m5_forecast_from_terms",
    _SERIES_DAYS
    + f""", f AS ({_RECURSION}), psi AS ({_RESPONSE}), g AS (
 SELECT f.region, f.lo + CAST(f.n - 1 AS INTEGER) AS date, m, {SIGMA} * CASE WHEN f.n > len(s.ys) THEN sqrt(total) ELSE 1.0 END AS sd
 FROM f JOIN s USING (region) LEFT JOIN psi ON psi.h = f.n - len(s.ys))
SELECT region, date, round(greatest(m, 0.0), 2) AS predicted_revenue, round(greatest(m - 1.96 * sd, 0.0), 2) AS lower,
 round(greatest(m + 1.96 * sd, 0.0), 2) AS upper, 'sarima' AS method FROM g""",
)
def m5_terms(spark, sf):
    """A store with given terms: the last thirty days of each region and sixty days ahead."""
    daily = buckets.daily_series(sales(spark, sf, ["region"]), by=["region"])
    store = stage(forecast_store.store_with_terms(daily, AR, MA, SIGMA, ["region"]), "store")
    last = store.agg(F.max("last_date")).first()[0]
    days = (last - dt.timedelta(days=29), last + dt.timedelta(days=60))
    return rounded(forecast_store.forecast_from_store(store, *days, by=["region"]), 2)


# --- drift -----------------------------------------------------------------------------

DRIFTING = ["units_sold", "discount_applied", "revenue", "clicks", "ad_cpc"]
_LIST = ", ".join(f"'{c}'" for c in DRIFTING)
_LONG = f""", v AS (SELECT unnest([{_LIST}]) AS col, unnest([{', '.join(DRIFTING)}]) AS val, {_CUT} AS new FROM sales)"""


@query(
    "drift_ks",
    SALES
    + _LONG
    + """, n AS (SELECT col, count(*) FILTER (NOT new) AS b, count(*) FILTER (new) AS m FROM v GROUP BY 1),
d AS (SELECT col, val, sum(count(*) FILTER (NOT new)) OVER w AS cb, sum(count(*) FILTER (new)) OVER w AS cm
      FROM v GROUP BY col, val WINDOW w AS (PARTITION BY col ORDER BY val)),
k AS (SELECT col, b, m, max(abs(cb / b - cm / m)) AS dist FROM d JOIN n USING (col) GROUP BY ALL),
l AS (SELECT *, sqrt(CAST(b AS DOUBLE) * m / (b + m)) * dist AS lam FROM k)
SELECT col AS "column", b AS base_rows, m AS current_rows, round(dist, 9) AS distance,
 round(CASE WHEN lam < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, list_sum(list_transform(range(1, 101),
  lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * k * k * lam * lam))))) END, 6) AS p_value FROM l""",
)
def drift_ks(spark, sf):
    """Sales of the last days against all before them, column by column."""
    out = drift.ks_distances(*_parts(spark, sf, DRIFTING), DRIFTING)
    return rounded(out, {"distance": 9, "p_value": 6})


_EDGES = f""", e AS (SELECT col, list_distinct(quantile_cont(val, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM v WHERE NOT new GROUP BY 1),
cells AS (
 SELECT col, CAST(len(list_filter(edges, lambda x: val > x)) AS VARCHAR) AS cell, new FROM v JOIN e USING (col)
 UNION ALL SELECT unnest(['category', 'region']), unnest([category, region]), {_CUT} FROM sales
), n AS (SELECT col, cell, count(*) FILTER (NOT new) AS b, count(*) FILTER (new) AS m FROM cells GROUP BY ALL),
p AS (SELECT col, cell, (b + 0.5) / (sum(b) OVER w + 0.5 * count(*) OVER w) AS base_share,
             (m + 0.5) / (sum(m) OVER w + 0.5 * count(*) OVER w) AS current_share FROM n WINDOW w AS (PARTITION BY col))
"""


def _stability(spark, sf):
    old, new = (stage(df, "part") for df in _parts(spark, sf, [*DRIFTING, *BY]))
    edges = drift.fit_edges(old, DRIFTING)
    return drift.stability_cells(old, new, edges, ["category", "region"])


@query(
    "drift_psi_cells",
    SALES
    + _LONG
    + _EDGES
    + """SELECT col AS "column", cell, round(base_share, 9) AS base_share, round(current_share, 9) AS current_share,
 round((current_share - base_share) * ln(current_share / base_share), 9) AS part FROM p""",
)
def drift_psi_cells(spark, sf):
    """Shares of each bin and category before and in the last days."""
    return rounded(_stability(spark, sf), 9)


@query(
    "drift_psi",
    SALES
    + _LONG
    + _EDGES
    + """SELECT col AS "column", round(psi, 9) AS psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'shifted' END AS level
 FROM (SELECT col, sum((current_share - base_share) * ln(current_share / base_share)) AS psi FROM p GROUP BY 1)""",
)
def drift_psi(spark, sf):
    return rounded(drift.stability_index(_stability(spark, sf)), 9)


# --- missing values --------------------------------------------------------------------

GAPS_SQL = """, g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, category, region,
 CASE WHEN l_orderkey % 7 <> 0 AND NOT (region = 'ASIA' AND category = 'LARGE') AND category <> 'PROMO' THEN units_sold END AS units_sold,
 CASE WHEN l_orderkey % 11 <> 0 THEN revenue END AS revenue FROM sales)"""
_FILL = ", ".join(
    f"""round(coalesce({c}, avg({c}) OVER (PARTITION BY category, region), avg({c}) OVER (PARTITION BY category), avg({c}) OVER ()), 4) AS {c},
 CAST({c} IS NULL AS DOUBLE) AS {c}_missing"""
    for c in ("units_sold", "revenue")
)


@query("prep_imputed_sales", SALES + GAPS_SQL + f" SELECT {ID_SQL}, {_FILL} FROM g")
def prep_imputed(spark, sf):
    """Sales with values taken away by key (a whole group and a whole category among them), filled in."""
    df = sales(spark, sf, BY)
    lost = (F.col("l_orderkey") % 7 == 0) | ((F.col("region") == "ASIA") & (F.col("category") == "LARGE")) | (F.col("category") == "PROMO")
    gaps = df.withColumns(
        {"units_sold": F.when(~lost, F.col("units_sold")), "revenue": F.when(F.col("l_orderkey") % 11 != 0, F.col("revenue"))}
    )
    columns = ["units_sold", "revenue"]
    state = stage(impute.fit_imputer(gaps, columns), "imputer")
    out = impute.apply_imputer(gaps, state, columns)
    return rounded(out.select(*IDS, *columns, *map(impute.flag, columns)), 4)


# --- intervals -------------------------------------------------------------------------

_STEPS = f"[{', '.join(map(str, bootstrap.STEPS))}]"


@query(
    "a11_mean_bootstrap_interval",
    SALES
    + f""", d AS (SELECT region, month(transaction_date) AS month, units_sold, unnest(range(0, {bootstrap.REPLICATES})) AS r,
 concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM sales),
w AS (SELECT region, month, units_sold, r, CAST('0x' || substr(md5('0|' || r // 8 || '|' || k), 4 * (r % 8) + 1, 4) AS INTEGER) AS u FROM d),
s AS (SELECT region, month, r, sum(units_sold * len(list_filter({_STEPS}, lambda x: u >= x))) AS total,
             sum(len(list_filter({_STEPS}, lambda x: u >= x))) AS n FROM w GROUP BY ALL),
b AS (SELECT region, month, quantile_cont(total / n, 0.025) AS lower, quantile_cont(total / n, 0.975) AS upper FROM s GROUP BY ALL),
m AS (SELECT region, month(transaction_date) AS month, count(*) AS n, avg(units_sold) AS mean FROM sales GROUP BY ALL)
SELECT region, CAST(month AS INTEGER) AS month, n, round(mean, 6) AS mean, round(lower, 6) AS lower, round(upper, 6) AS upper FROM b JOIN m USING (region, month)""",
)
def a11_bootstrap(spark, sf):
    """Mean units by region and month with the interval that a bar plot draws."""
    df = sales(spark, sf, ["region"]).withColumn("month", F.month("transaction_date"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return rounded(bootstrap.mean_interval(df, ["region", "month"], "units_sold", keys), 6)


# --- stored layouts --------------------------------------------------------------------


@query(
    "j7_bucketed_star",
    SALES + f"SELECT {ID_SQL}, customer_id, category, region, round(revenue, 6) AS revenue FROM sales",
)
def j7_bucketed(spark, sf):
    """Sales and orders stored in buckets of the order key and merged without a shuffle."""
    path = shared_folder(spark, "star")
    facts, orders = bucketed.write_star(spark, sf, path, "star_" + path.rsplit("-", 1)[-1])
    out = bucketed.star_join(facts, orders)
    return rounded(out.select(*IDS, "customer_id", "category", "region", "revenue"), {"revenue": 6})
