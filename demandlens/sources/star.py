"""Sales transactions over the star schema (lineitem, orders, customer, part, events).

Only the joins a caller asks for are planned. Every foreign key of ``lineitem`` and
``orders`` is assumed to be satisfied, as in any declared star schema; pass
``enforce=True`` to join all dimensions whatever is selected.

No join carries a broadcast hint: Spark broadcasts a dimension when its size is under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise sorts and merges, with adaptive
skew splitting for a hot order, customer or product.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Unique, total order of the sales rows: (l_orderkey, l_linenumber) repeats.
ORDER_KEYS = [
    "transaction_date",
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
]
AD_COLUMNS = ["clicks", "impressions", "conversion_rate", "ad_ctr", "ad_cpc", "ad_spend"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ad_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ad activity per user: clicks, impressions, events, mean click value."""
    kind, value = F.col("event_type"), F.col("value")
    return (
        table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(
            F.count_if(kind == "click").cast("double").alias("clicks"),
            F.count_if(kind == "view").cast("double").alias("impressions"),
            F.count("*").cast("double").alias("n_events"),
            F.round(F.coalesce(F.avg(F.when(kind == "click", value)), F.lit(0.0)), 6).alias("ad_cpc"),
        )
    )


def sales(
    spark: SparkSession,
    sf_dir: str,
    columns: Iterable[str] = ("category", "region"),
    enforce: bool = False,
) -> DataFrame:
    """One row per sale.

    ``columns`` names what is needed beyond the fact columns: any of ``category``,
    ``list_price``, ``region``, ``customer_id`` and the ad columns.
    """
    wanted = set(columns)
    li = table(spark, sf_dir, "lineitem")
    df = li.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        F.col("l_shipdate").cast("date").alias("transaction_date"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").alias("units_sold"),
        F.col("l_discount").alias("discount_applied"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
    )
    if enforce or wanted & {"category", "list_price"}:
        part = table(spark, sf_dir, "part").select(
            "p_partkey", F.col("p_type").alias("category"), F.col("p_retailprice").alias("list_price")
        )
        df = df.join(part, df.l_partkey == part.p_partkey).drop("p_partkey")
    with_ads = enforce or bool(wanted & set(AD_COLUMNS))
    with_region = enforce or "region" in wanted
    if with_ads or with_region or "customer_id" in wanted:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("customer_id"))
        if with_region:
            orders = orders.join(customer_region(spark, sf_dir), orders.customer_id == F.col("c_custkey"))
            orders = orders.drop("c_custkey")
        if with_ads:
            # The number of users is one value: a scalar subquery, not a join. It is
            # projected first; as part of a broadcast join key it would not be waited for.
            users = table(spark, sf_dir, "events").agg(F.count_distinct("user_id")).scalar()
            orders = orders.withColumn("user_id", F.col("customer_id") % users)
            orders = orders.join(ad_totals(spark, sf_dir), "user_id").drop("user_id")
            orders = orders.withColumns(
                {
                    "conversion_rate": F.coalesce(F.try_divide("clicks", "impressions"), F.lit(0.0)),
                    "ad_ctr": F.col("clicks") / F.col("n_events"),
                    "ad_spend": F.col("clicks") / F.col("n_events") * F.col("ad_cpc") * 1000.0,
                }
            ).drop("n_events")
        df = df.join(orders, df.l_orderkey == orders.o_orderkey).drop("o_orderkey")
    return df


def customer_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("region"))
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "region")
    return customer.join(places, customer.c_nationkey == places.n_nationkey).select("c_custkey", "region")


def list_price_scores(
    spark: SparkSession, sf_dir: str, columns: Iterable[str] = ("category", "region")
) -> DataFrame:
    """Sales with ``predicted_revenue`` = list price x units x (1 - discount).

    A deterministic stand-in for a model's output, used where a report on predictions
    needs an exact SQL check.
    """
    df = sales(spark, sf_dir, {*columns, "list_price"})
    predicted = F.col("units_sold") * F.col("list_price") * (1 - F.col("discount_applied"))
    return df.withColumn("predicted_revenue", predicted)
