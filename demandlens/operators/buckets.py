"""Calendar buckets with gap fill, and time splits.

Rows are summed per bucket first (map-side combined), so what is joined to the calendar
has at most one row per bucket and series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlens.functions import calendar as cal


def spine(df: DataFrame, grain: str = "day", date: str = "date", by: Sequence[str] = ()) -> DataFrame:
    """Every bucket label between the first and the last label of ``df`` (per series)."""
    ends = df.groupBy(*by).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    ends = ends.filter(F.col("_lo").isNotNull())
    steps = F.sequence(F.lit(0), cal.bucket_count(F.col("_lo"), F.col("_hi"), grain) - 1)
    return ends.select(*by, "_lo", F.explode(steps).alias("_i")).select(
        *by, cal.bucket_step(F.col("_lo"), F.col("_i"), grain).alias(date)
    )


def bucket(
    df: DataFrame,
    grain: str = "day",
    measure: str = "revenue",
    date: str = "transaction_date",
    by: Sequence[str] = (),
    fill: str = "zero",
) -> DataFrame:
    """Sum and row count per calendar bucket: (by..., date, measure, transaction_count).

    ``fill``: ``zero`` gives empty buckets 0, ``ffill`` repeats the last value, ``none``
    returns only buckets that have rows.
    """
    sums = observed(df, grain, measure, date, by)
    if fill == "none":
        return sums
    keys = [*by, "date"]
    filled = spine(sums, grain, "date", by).join(sums, keys, "left")
    count = F.coalesce("transaction_count", F.lit(0)).alias("transaction_count")
    if fill == "zero":
        return filled.select(*keys, F.coalesce(measure, F.lit(0.0)).alias(measure), count)
    if fill == "ffill":
        return forward_fill(filled, measure, "date", by).select(*keys, measure, count)
    raise ValueError(f"unknown fill: {fill}")


def observed(
    df: DataFrame, grain: str, measure: str = "revenue", date: str = "transaction_date", by: Sequence[str] = ()
) -> DataFrame:
    """Sum and count per bucket that has rows; grouping by several keys fills nothing."""
    label = cal.bucket_end(F.col(date), grain).alias("date")
    dated = df.filter(F.col(date).isNotNull())
    return dated.groupBy(*by, label).agg(F.sum(measure).alias(measure), F.count("*").alias("transaction_count"))


def daily_series(df: DataFrame, measure: str = "revenue", by: Sequence[str] = (), fill: str = "zero") -> DataFrame:
    return bucket(df, "day", measure, by=by, fill=fill).drop("transaction_count")


def series_window(date: str = "date", by: Sequence[str] = ()) -> Window:
    """Ordered window over a calendar series.

    Without series keys this is a single partition: a series has one row per calendar
    bucket, so its length is bounded by the calendar and not by the number of sales.
    """
    return Window.partitionBy(*by).orderBy(date) if by else Window.partitionBy(F.lit(1)).orderBy(date)


def forward_fill(df: DataFrame, measure: str, date: str = "date", by: Sequence[str] = ()) -> DataFrame:
    """The last present value; df has one row per bucket and series."""
    w = series_window(date, by).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(measure, F.last(measure, ignorenulls=True).over(w))


def date_range(df: DataFrame, start: Column, end: Column, name: str = "date") -> DataFrame:
    """One row per day from start to end inclusive; none when end is before start."""
    days = F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<date>"))
    return df.select(F.explode(days).alias(name))


def split_date(df: DataFrame, date: str = "transaction_date", months: int = 6) -> DataFrame:
    """One row: the last date of the training part."""
    return df.agg(F.add_months(F.max(date), -months).alias("split_date"))


def time_split(df: DataFrame, date: str = "transaction_date", months: int = 6) -> tuple[DataFrame, DataFrame]:
    """(train, test): the last months are the test part."""
    cut = split_date(df, date, months).first()[0]  # one date
    return df.filter(F.col(date) <= F.lit(cut)), df.filter(F.col(date) > F.lit(cut))
