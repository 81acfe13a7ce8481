"""Keyed alignment of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.functions.calendar import DAY_NAMES
from demandlens.functions.numeric import percent_difference
from demandlens.session import stage


def align_by_key(actuals: DataFrame, predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows present on both sides. The keys must be unique on one side."""
    return actuals.join(predictions, list(keys))


def in_day_order(df: DataFrame, day: str = "day_of_week") -> DataFrame:
    """Reindex to Monday..Sunday with a position; absent days are NULL."""
    spark = df.sparkSession
    names = F.array(*[F.lit(n) for n in DAY_NAMES])
    days = spark.range(1).select(F.posexplode(names).alias("day_position", day))
    # The day side has seven rows; the values have at most one row per day name.
    return days.join(df, day, "left")


def segment_averages(df: DataFrame, key: str, measure: str = "revenue") -> DataFrame:
    return df.groupBy(key).agg(F.avg(measure).alias(f"{key}_average"))


def compare_to_segments(
    predictions: DataFrame,
    history: DataFrame,
    keys: Sequence[str] = ("category", "region"),
    measure: str = "revenue",
    predicted: str = "predicted_revenue",
) -> DataFrame:
    """Each prediction next to the real averages of its segments and of all sales.

    The averages are written first: Spark then knows their size when it plans the joins, and
    does not shuffle the predictions into one task for each segment if there are few.
    """
    overall = history.agg(F.avg(measure)).scalar()
    out = predictions
    for key in keys:
        out = out.join(stage(segment_averages(history, key, measure), "averages"), key, "left")
        out = out.withColumn(f"{key}_diff_pct", percent_difference(predicted, f"{key}_average"))
    return out.withColumn("overall_average", overall).withColumn(
        "overall_diff_pct", percent_difference(predicted, F.col("overall_average"))
    )
