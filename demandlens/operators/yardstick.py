"""Window-only forecasts: seasonal naive and moving average, and forecast intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlens.operators.buckets import series_window

# Two-sided normal quantiles of the offered confidence levels.
Z_VALUES = {0.5: 0.674, 0.6: 0.842, 0.7: 1.036, 0.8: 1.282, 0.9: 1.645, 0.95: 1.96, 0.99: 2.576}
SPREAD_FACTOR = 0.2


def one_step(
    df: DataFrame, measure: str = "revenue", season: int = 7, width: int = 7, date: str = "date", by: Sequence[str] = ()
) -> DataFrame:
    """For each bucket: the value one season before, and the mean of the ``width`` before it."""
    w = series_window(date, by)
    before = w.rowsBetween(-width, -1)
    return df.withColumns(
        {
            "seasonal_naive": F.lag(measure, season).over(w),
            "moving_average": F.when(F.count(measure).over(before) == width, F.avg(measure).over(before)),
        }
    )


def seasonal_naive_forecast(
    df: DataFrame,
    horizon: int,
    measure: str = "revenue",
    season: int = 7,
    date: str = "date",
    by: Sequence[str] = (),
) -> DataFrame:
    """``horizon`` days after the end of each series, repeating its last season.

    Only the last ``season`` rows of a series are kept and each is unrolled over the
    days it stands for.
    """
    order = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    back = F.row_number().over(order.orderBy(F.col(date).desc()))
    last = df.withColumn("_back", back).filter(F.col("_back") <= season)
    ahead = F.lit(season) - F.col("_back") + 1  # 1 for the oldest of the season
    days = F.when(ahead <= horizon, F.sequence(ahead, F.lit(horizon), F.lit(season))).otherwise(
        F.array().cast("array<int>")
    )
    end = F.date_add(F.col(date), F.col("_back") - 1)
    out = last.select(*by, end.alias("_end"), F.explode(days).alias("_h"), F.col(measure).alias("_v"))
    return out.select(
        *by, F.date_add("_end", F.col("_h")).alias("date"), F.greatest(F.col("_v"), F.lit(0.0)).alias("predicted_revenue")
    )


def with_interval(
    df: DataFrame, level: float = 0.95, measure: str = "predicted_revenue", deviation: float | None = None
) -> DataFrame:
    """Bounds at z times a fifth of the forecast's deviation, or times a given deviation."""
    z = Z_VALUES[level]
    sd = F.lit(deviation) if deviation is not None else df.agg(F.stddev_samp(measure)).scalar() * SPREAD_FACTOR
    return df.withColumns(
        {
            "lower_bound": F.greatest(F.col(measure) - z * sd, F.lit(0.0)),
            "upper_bound": F.col(measure) + z * sd,
        }
    )


def monthly_summary(df: DataFrame, measure: str = "predicted_revenue", date: str = "date") -> DataFrame:
    """Total, mean, deviation and days per calendar month."""
    return df.groupBy(F.trunc(date, "month").alias("month")).agg(
        F.sum(measure).alias("total"),
        F.avg(measure).alias("average"),
        F.stddev_samp(measure).alias("std"),
        F.count(measure).alias("days"),
    )
