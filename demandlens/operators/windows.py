"""Lag, rolling and cumulative features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlens.operators import ordering
from demandlens.operators.buckets import series_window

LAGS = (1, 7, 14, 30)
ROLLS = (7, 14, 30)
# Column prefix of the features -> source column.
LAGGED = {"revenue": "revenue", "units": "units_sold"}


def lag_columns(lags: Sequence[int] = LAGS, measures: Mapping[str, str] = LAGGED) -> list[str]:
    return [f"{m}_lag_{k}" for k in lags for m in measures]


def rolling_columns(rolls: Sequence[int] = ROLLS, measures: Mapping[str, str] = LAGGED) -> list[str]:
    return [f"{m}_rollmean_{w}" for w in rolls for m in measures]


def full_mean(column: str, width: int, over: Window, exclude_current: bool = False) -> Column:
    """Mean of the last ``width`` rows; NULL until there are that many values."""
    frame = over.rowsBetween(-width, -1) if exclude_current else over.rowsBetween(-(width - 1), 0)
    return F.when(F.count(column).over(frame) == width, F.avg(column).over(frame))


def lag_rolling(
    df: DataFrame,
    order: Sequence[str],
    lags: Sequence[int] = LAGS,
    rolls: Sequence[int] = ROLLS,
    measures: Mapping[str, str] = LAGGED,
    exclude_current: bool = False,
    keep_row_number: bool = False,
    block_rows: int = ordering.BLOCK_ROWS,
    partitions: int | None = None,
) -> DataFrame:
    """Lags and rolling means by row over the whole table, in the given total order.

    ``partitions`` is the number of partitions of the result, if not that of any shuffle.
    """
    numbered = df if "rn" in df.columns else ordering.with_row_number(df, order)
    halo = max([*lags, *rolls])
    blocks = ordering.overlapping_blocks(numbered, halo, block_rows=block_rows)
    if partitions:
        blocks = blocks.repartition(partitions, "_block")
    w = ordering.block_window()
    features: dict[str, Column] = {}
    for k in lags:
        features.update({f"{m}_lag_{k}": F.lag(c, k).over(w) for m, c in measures.items()})
    for width in rolls:
        features.update(
            {f"{m}_rollmean_{width}": full_mean(c, width, w, exclude_current) for m, c in measures.items()}
        )
    out = ordering.own_rows(blocks.withColumns(features))
    return out if keep_row_number else out.drop("rn")


def series_lag_rolling(
    df: DataFrame,
    measure: str,
    lags: Sequence[int] = LAGS,
    rolls: Sequence[int] = ROLLS,
    date: str = "date",
    by: Sequence[str] = (),
) -> DataFrame:
    """The same features on a bucketed series (one row per date and series)."""
    w = series_window(date, by)
    features = {f"{measure}_lag_{k}": F.lag(measure, k).over(w) for k in lags}
    features.update({f"{measure}_rollmean_{n}": full_mean(measure, n, w) for n in rolls})
    return df.withColumns(features)


def moving_averages(
    df: DataFrame,
    measure: str = "revenue",
    widths: Sequence[int] = (7, 14),
    more_than: int = 10,
    date: str = "date",
    by: Sequence[str] = (),
) -> DataFrame:
    """Means over up to ``width`` buckets, partial frames included.

    Series of ``more_than`` buckets or fewer get NULL: they are too short for a trend.
    """
    w = series_window(date, by)
    length = F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumns(
        {f"ma_{n}": F.when(length > more_than, F.avg(measure).over(w.rowsBetween(-(n - 1), 0))) for n in widths}
    )


def short_moving_average(df: DataFrame, measure: str = "predicted_revenue", date: str = "date") -> DataFrame:
    """Seven-bucket mean where there are more than three buckets.

    A frame of min(7, n) rows with partial frames allowed equals a frame of 7 rows.
    """
    return moving_averages(df, measure, (7,), 3, date).withColumnRenamed("ma_7", "ma")


def cumulative(df: DataFrame, measure: str = "predicted_revenue", date: str = "date", by: Sequence[str] = ()) -> DataFrame:
    w = series_window(date, by).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cumulative_revenue", F.sum(measure).over(w))


def trend_summary(df: DataFrame, measure: str = "predicted_revenue", date: str = "date", width: int = 7) -> DataFrame:
    """First and last value of the moving mean and the change in percent (0 if it starts at 0 or below)."""
    trend = moving_averages(df, measure, (width,), 0, date)
    out = trend.agg(
        F.min_by(f"ma_{width}", date).alias("start_trend"), F.max_by(f"ma_{width}", date).alias("end_trend")
    )
    change = (F.col("end_trend") - F.col("start_trend")) / F.col("start_trend") * 100
    return out.withColumn("trend_pct", F.when(F.col("start_trend") > 0, change).otherwise(F.lit(0.0)))


def decompose(
    df: DataFrame, measure: str = "revenue", period: int = 7, date: str = "date", by: Sequence[str] = ()
) -> DataFrame:
    """Classical additive decomposition of a daily series.

    trend: centred mean of ``period`` rows (odd), NULL at both ends; seasonal: mean of
    (value - trend) per weekday, centred to average 0 over the seven days; residual: rest.
    """
    half = period // 2
    w = series_window(date, by).rowsBetween(-half, half)
    trend = df.withColumn("trend", F.when(F.count(measure).over(w) == period, F.avg(measure).over(w)))
    trend = trend.withColumn("_dow", F.weekday(date))
    # Seven rows per series: joined back by size, equal to a window but without
    # sorting the series once per weekday.
    effect = trend.groupBy(*by, "_dow").agg(F.avg(F.col(measure) - F.col("trend")).alias("_effect"))
    centre = effect.groupBy(*by).agg(F.avg("_effect").alias("_centre"))
    effect = effect.join(centre, list(by)) if by else effect.withColumn("_centre", centre.scalar())
    effect = effect.select(*by, "_dow", (F.col("_effect") - F.col("_centre")).alias("seasonal"))
    out = trend.join(effect, [*by, "_dow"])
    residual = F.col(measure) - F.col("trend") - F.col("seasonal")
    return out.select(*by, date, measure, "trend", "seasonal", residual.alias("residual"))


def share_of_total(df: DataFrame, keys: Sequence[str], measure: str = "revenue") -> DataFrame:
    """Group totals and their share; the grand total is a scalar over the groups."""
    groups = df.groupBy(*keys).agg(F.sum(measure).alias(measure))
    total = groups.agg(F.sum(measure)).scalar()
    return groups.withColumn("share", F.try_divide(F.col(measure), total))


def top_features(df: DataFrame, k: int = 5, name: str = "feature", measure: str = "importance") -> DataFrame:
    """The k largest with rank and cumulative share; ``df`` has one row per feature."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.col(measure).desc(), name)
    total = F.sum(measure).over(Window.partitionBy(F.lit(1)))
    running = F.sum(measure).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        df.withColumn("rank", F.row_number().over(w))
        .withColumn("cumulative_share", F.try_divide(running, total))
        .filter(F.col("rank") <= k)
    )
