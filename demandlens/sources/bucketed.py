"""Tables that are written once so that their joins need no shuffle.

Both sides of a join are stored in the same number of buckets of the join key, each bucket
sorted by it. A join on that key then merges bucket with bucket; any number of queries read
the layout that was paid for once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.sources.star import customer_region, sales, table

BUCKETS = 64


def write_bucketed(df: DataFrame, name: str, path: str, key: str, sort: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """Store ``df`` at ``path`` as table ``name``, bucketed and sorted by ``key``."""
    # One task for each bucket, so that a bucket is one sorted file.
    dealt = df.repartition(buckets, key)
    writer = dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key, *sort).option("path", path)
    writer.mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def write_star(spark: SparkSession, sf_dir: str, path: str, prefix: str, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Processed sales and orders (with their customer's region), both in buckets of the order key."""
    facts = sales(spark, sf_dir, ["category"])
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("customer_id"))
    regions = customer_region(spark, sf_dir)
    placed = orders.join(regions, orders.customer_id == F.col("c_custkey")).drop("c_custkey")
    return (
        write_bucketed(facts, f"{prefix}_sales", f"{path}/sales", "l_orderkey", buckets=buckets),
        write_bucketed(placed, f"{prefix}_orders", f"{path}/orders", "order_key", buckets=buckets),
    )


def star_join(facts: DataFrame, orders: DataFrame) -> DataFrame:
    """Sales with customer and region; the merge of two bucketed tables."""
    return facts.join(orders.hint("merge"), facts.l_orderkey == orders.order_key).drop("order_key")
