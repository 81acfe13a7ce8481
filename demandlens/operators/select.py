"""Projections, filters and predicates."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID_COLUMNS = ("transaction_id", "customer_id", "product_id")
CORRELATED_COLUMNS = ("impressions", "ad_ctr")


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Names that are absent are ignored."""
    return df.drop(*names)


def keep_existing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select([c for c in names if c in df.columns])


def columns_like(
    columns: Iterable[str], contains: Sequence[str] = (), prefix: Sequence[str] = ()
) -> list[str]:
    """Names holding any of the parts, or starting with any of the prefixes."""
    return [c for c in columns if any(p in c for p in contains) or c.startswith(tuple(prefix))]


def columns_matching(columns: Iterable[str], pattern: str) -> list[str]:
    return [c for c in columns if re.search(pattern, c)]


def column_difference(expected: Sequence[str], actual: Sequence[str]) -> tuple[list[str], list[str]]:
    """(missing, extra) column names, each in the order of its own list."""
    have, want = set(actual), set(expected)
    return [c for c in expected if c not in have], [c for c in actual if c not in want]


def align_columns(df: DataFrame, expected: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly ``expected`` in that order: absent ones are 0.0, others are dropped.

    ``keep`` names key or context columns carried in front.
    """
    have = set(df.columns)
    cols: list[Column] = [F.col(c) for c in keep]
    cols += [F.col(c).cast("double").alias(c) if c in have else F.lit(0.0).alias(c) for c in expected]
    return df.select(cols)


def between_dates(df: DataFrame, start: dt.date, end: dt.date | None = None, date: str = "transaction_date") -> DataFrame:
    """Both ends included; without ``end`` a single day.

    The comparison reaches the Parquet scan, also through a cast from timestamp.
    """
    return df.filter(F.col(date).between(F.lit(start), F.lit(end or start)))


def members(df: DataFrame, column: str, values: Sequence[str], everything: str = "All") -> DataFrame:
    """Rows whose value is listed; the word for everything switches the filter off."""
    return df if everything in values else df.filter(F.col(column).isin(list(values)))


def range_comparison(
    df: DataFrame, feature: str, low: float, high: float, measure: str = "predicted_revenue"
) -> DataFrame:
    """Rows in a feature range against all rows, in one pass."""
    inside = F.col(feature).between(low, high)
    filtered = F.coalesce(F.avg(F.when(inside, F.col(measure))), F.lit(0.0))
    totals = df.agg(
        F.count_if(inside).alias("filtered_records"),
        F.count("*").alias("total_records"),
        filtered.alias("filtered_avg"),
        F.avg(measure).alias("overall_avg"),
    )
    gap = F.col("filtered_avg") - F.col("overall_avg")
    return totals.withColumns(
        {
            "avg_impact": gap,
            "avg_impact_pct": (F.try_divide("filtered_avg", "overall_avg") - 1) * 100,
        }
    )


def any_null(columns: Sequence[str]) -> Column:
    return F.greatest(*[F.col(c).isNull().cast("int") for c in columns], F.lit(0)) == 1


def null_row_count(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = columns or df.columns
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(any_null(names)).alias("rows_with_null"),
    )


def drop_null_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns or df.columns))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def preview(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def latest_rows(df: DataFrame, order: Sequence[str], n: int = 50) -> DataFrame:
    """The last ``n`` rows of the total order (a top-n, not a full sort)."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def seeded_sample(df: DataFrame, keys: Sequence[str], n: int = 100, seed: int = 42) -> DataFrame:
    """At most ``n`` rows, the same ones at every run and on any partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys])
    return df.withColumn("_h", F.md5(text)).orderBy("_h", *keys).limit(n).drop("_h")


def sort_by_measure(df: DataFrame, measure: str, ties: Sequence[str] = (), ascending: bool = False) -> DataFrame:
    col = F.col(measure)
    return df.orderBy(col.asc() if ascending else col.desc(), *ties)


def sort_by_magnitude(df: DataFrame, measure: str, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.abs(measure), *ties)
