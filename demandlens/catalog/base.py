"""Registry of queries, shared SQL parts, and rounding for value comparison."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from demandlens.functions.numeric import round_half_away

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
MODULES = ("descriptive", "series", "preparation", "modelling", "files", "upkeep", "stores")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query registered twice: {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = _expand(sql)
        return fn

    return register


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"demandlens.catalog.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def rounded(df: DataFrame, digits: Mapping[str, int] | int = 4) -> DataFrame:
    """Double columns rounded, so that the order of additions does not show.
    """
    if isinstance(digits, int):
        digits = {f.name: digits for f in df.schema if f.dataType.typeName() == "double"}
    return df.withColumns({c: round_half_away(c, n) for c, n in digits.items()})


# Stands for the WITH clause that defines `sales`; see `_expand`.
SALES = "/*sales*/"

ADS_SQL = """ads AS (
  SELECT user_id,
         CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS DOUBLE) AS clicks,
         CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS DOUBLE) AS impressions,
         CAST(count(*) AS DOUBLE) AS n_events,
         round(coalesce(avg(CASE WHEN event_type = 'click' THEN value END), 0.0), 6) AS ad_cpc
  FROM events GROUP BY user_id
), nu AS (SELECT count(DISTINCT user_id) AS n_users FROM events),
"""
FACT_SQL = """l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice,
       CAST(l.l_shipdate AS DATE) AS transaction_date, l.l_partkey AS product_id,
       l.l_quantity AS units_sold, l.l_discount AS discount_applied,
       l.l_extendedprice * (1 - l.l_discount) AS revenue"""


def _expand(sql: str) -> str:
    """Put in the joins whose columns the query text mentions."""
    if SALES not in sql:
        return sql
    body = sql.replace(SALES, "")

    def mentions(pattern: str) -> bool:
        return re.search(rf"\b({pattern})\b", body) is not None

    part = mentions("category|list_price|predicted_revenue")
    region, ads = mentions("region"), mentions("clicks|impressions|conversion_rate|ad_ctr|ad_cpc|ad_spend")
    columns, joins = [FACT_SQL], ["FROM lineitem l"]
    if part:
        columns.append("p.p_type AS category, p.p_retailprice AS list_price")
        columns.append("l.l_quantity * p.p_retailprice * (1 - l.l_discount) AS predicted_revenue")
        joins.append("JOIN part p ON l.l_partkey = p.p_partkey")
    if region or ads or mentions("customer_id"):
        columns.append("o.o_custkey AS customer_id")
        joins.append("JOIN orders o ON l.l_orderkey = o.o_orderkey")
    if region:
        columns.append("r.r_name AS region")
        joins.append("JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation na ON c.c_nationkey = na.n_nationkey")
        joins.append("JOIN region r ON na.n_regionkey = r.r_regionkey")
    if ads:
        columns.append("a.clicks, a.impressions, coalesce(a.clicks / nullif(a.impressions, 0.0), 0.0) AS conversion_rate")
        columns.append("a.clicks / a.n_events AS ad_ctr, a.ad_cpc, a.clicks / a.n_events * a.ad_cpc * 1000.0 AS ad_spend")
        joins.append("CROSS JOIN nu JOIN ads a ON a.user_id = o.o_custkey % nu.n_users")
    select = ",\n       ".join(columns)
    source = "\n".join(joins)
    clause = f"WITH {ADS_SQL if ads else ''}sales AS (\nSELECT {select}\n{source}\n)\n"
    return sql.replace(SALES, clause)


DAILY = (
    SALES
    + """, d0 AS (SELECT transaction_date AS date, sum(revenue) AS revenue, count(*) AS n FROM sales GROUP BY 1),
days AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM d0), (SELECT max(date) FROM d0), INTERVAL 1 DAY)) AS DATE) AS date),
daily AS (SELECT days.date, coalesce(d0.revenue, 0.0) AS revenue, coalesce(d0.n, 0) AS transaction_count
          FROM days LEFT JOIN d0 ON d0.date = days.date)
"""
)

FORECAST = (
    DAILY
    + """, season AS (SELECT date, revenue, row_number() OVER (ORDER BY date DESC) AS b FROM daily QUALIFY b <= 7),
forecast AS (SELECT (SELECT max(date) FROM daily) + CAST(g.h AS INTEGER) AS date, greatest(revenue, 0.0) AS predicted_revenue
             FROM generate_series(1, 60) g(h) JOIN season ON b = 7 - ((g.h - 1) % 7))
"""
)

ROW_ORDER = "transaction_date, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
NUMBERED = SALES + f", numbered AS (SELECT *, row_number() OVER (ORDER BY {ROW_ORDER}) AS rn FROM sales)\n"
