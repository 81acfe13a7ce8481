"""Descriptive aggregations. Each is one shuffle after a map-side partial aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kpis(
    df: DataFrame,
    measure: str = "revenue",
    dimensions: Sequence[str] = ("category", "region"),
) -> DataFrame:
    """Total, rows, mean and the number of distinct values of each dimension.

    Grouping by the dimensions first keeps the distinct counts from expanding every
    input row; only the groups are expanded.
    """
    groups = df.groupBy(*dimensions).agg(
        F.sum(measure).alias("s"), F.count("*").alias("n"), F.count(measure).alias("m")
    )
    return groups.agg(
        F.sum("s").alias(f"total_{measure}"),
        F.sum("n").alias("num_transactions"),
        F.try_divide(F.sum("s"), F.sum("m")).alias(f"avg_{measure}"),
        *[F.count_distinct(d).alias(f"num_{d}") for d in dimensions],
    )


def prediction_kpis(df: DataFrame, measure: str = "predicted_revenue") -> DataFrame:
    return df.agg(
        F.sum(measure).alias("total"),
        F.avg(measure).alias("average"),
        F.max(measure).alias("maximum"),
        F.count(measure).alias("predictions"),
    )


def forecast_kpis(df: DataFrame, date: str = "date", measure: str = "predicted_revenue") -> DataFrame:
    return df.agg(
        F.sum(measure).alias("total"),
        F.avg(measure).alias("average"),
        F.max(measure).alias("maximum"),
        F.min(measure).alias("minimum"),
        (F.datediff(F.max(date), F.min(date)) + 1).alias("period_days"),
    )


def total_by(df: DataFrame, keys: Sequence[str], measure: str = "revenue") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(measure).alias(measure))


def total_and_count_by(df: DataFrame, keys: Sequence[str], measure: str = "revenue") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(measure).alias(measure), F.count("*").alias("transaction_count"))


def average_transaction_by(df: DataFrame, keys: Sequence[str], measure: str = "revenue") -> DataFrame:
    ratio = F.try_divide(F.col(measure), F.col("transaction_count"))
    return total_and_count_by(df, keys, measure).withColumn("avg_transaction_value", ratio)


def total_rollup(df: DataFrame, keys: Sequence[str], measure: str = "revenue") -> DataFrame:
    """Totals per key combination and every subtotal (absent keys are NULL).

    Rolled up from the finished groups, so the input rows are not expanded.
    """
    groups = df.groupBy(*keys).agg(F.sum(measure).alias("s"))
    return groups.cube(*keys).agg(F.sum("s").alias(measure))


def matrix(
    df: DataFrame,
    rows: Column | str,
    columns: str,
    values: Sequence,
    measure: str = "revenue",
    how: str = "avg",
    fill: float | None = None,
) -> DataFrame:
    """Pivot with a fixed list of column values (no extra job to find them)."""
    agg = {"avg": F.avg, "sum": F.sum}[how](measure)
    out = df.groupBy(rows).pivot(columns, list(values)).agg(agg)
    return out if fill is None else out.na.fill(fill, subset=[str(v) for v in values])


def mean_with_interval(df: DataFrame, keys: Sequence[Column | str], measure: str, z: float = 1.96) -> DataFrame:
    """Group means with a normal 95 % interval of the mean."""
    out = df.groupBy(*keys).agg(
        F.avg(measure).alias("mean"), F.stddev_samp(measure).alias("sd"), F.count(measure).alias("n")
    )
    half = z * F.col("sd") / F.sqrt(F.col("n"))
    return out.withColumns({"lower": F.col("mean") - half, "upper": F.col("mean") + half})


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value and their share of all rows (a total over the finished groups)."""
    counts = df.groupBy(column).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("share", F.try_divide(F.col("count").cast("double"), total))


def count_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("count"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier one in every column."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("n"))
    return groups.agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows")
    )


def null_counts(df: DataFrame) -> DataFrame:
    """Long table (column, rows, nulls) from one aggregate over all columns."""
    wide = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    return wide.unpivot("_rows", df.columns, "column", "nulls").select(
        "column", F.col("_rows").alias("rows"), "nulls"
    )


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"))


def bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: ``min_<c>`` and ``max_<c>`` of every column."""
    return df.agg(
        *[F.min(c).alias(f"min_{c}") for c in columns], *[F.max(c).alias(f"max_{c}") for c in columns]
    )


def extreme_dates(df: DataFrame, date: str = "date", measure: str = "predicted_revenue") -> DataFrame:
    """Dates of the highest and the lowest value, the earliest on ties."""
    age = F.datediff(F.lit("1970-01-01").cast("date"), F.col(date))
    present = df.filter(F.col(measure).isNotNull())
    return present.agg(
        F.max_by(F.col(date), F.struct(F.col(measure), age)).alias("max_date"),
        F.max(measure).alias("max_value"),
        F.min_by(F.col(date), F.struct(F.col(measure), F.col(date))).alias("min_date"),
        F.min(measure).alias("min_value"),
    )


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def pair_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson's r of each (left, right) column pair, long: (pair, left, right, r).

    Rows are unrolled into pairs and combined before the shuffle, which moves one small
    record per pair and task. As aggregates side by side the pairs would outgrow code
    generation (dozens of buffers per row) and run many times slower.
    """
    cells = [
        F.struct(F.lit(n).alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        for n, (a, b) in enumerate(pairs)
    ]
    long = df.select(F.inline(F.array(*cells))).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    spread = F.stddev_samp("x") * F.stddev_samp("y")
    found = long.groupBy("pair").agg(F.try_divide(F.covar_samp("x", "y"), spread).alias("r"))
    names = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for a, b in pairs])
    named = found.select("pair", F.get(names, F.col("pair")).alias("_p"), "r")
    return named.select("pair", "_p.left", "_p.right", "r")


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Upper triangle of the correlation matrix, long: (left, right, r), left before right."""
    return pair_correlations(df, list(combinations(columns, 2))).drop("pair")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Full matrix, one row per column name; the diagonal of a varying column is 1."""
    cells = pair_correlations(df, [*combinations(columns, 2), *[(c, c) for c in columns]]).drop("pair")
    both = F.array(
        F.struct(F.col("left").alias("column"), F.col("right").alias("other"), "r"),
        F.struct(F.col("right").alias("column"), F.col("left").alias("other"), "r"),
    )
    # At most (number of columns) squared rows reach this pivot.
    return cells.select(F.inline(both)).groupBy("column").pivot("other", list(columns)).agg(F.first("r"))


def feature_summary(df: DataFrame, numeric: Sequence[str], text: Sequence[str]) -> DataFrame:
    """Type and number of distinct values per column.

    Rows become (column, value) pairs that are combined before the shuffle, so a hot
    value moves once per task; the second level counts the distinct pairs.
    """
    cells = [
        F.struct(F.lit(c).alias("feature"), F.lit(kind).alias("type"), F.col(c).cast("string").alias("value"))
        for names, kind in ((numeric, "Numeric"), (text, "Categorical"))
        for c in names
    ]
    pairs = df.select(F.inline(F.array(*cells))).filter(F.col("value").isNotNull())
    return pairs.distinct().groupBy("feature", "type").agg(F.count("*").alias("unique_values"))


def impact_level(importance: Column) -> Column:
    return F.when(importance > 0.15, "High").when(importance > 0.05, "Medium").otherwise("Low")


def trend_line(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of ``y`` on ``x``."""
    n = F.regr_count(y, x)
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        n.alias("n"),
    )


def group_statistics(df: DataFrame, key: str, measure: str = "predicted_revenue") -> DataFrame:
    """Mean, median, count and standard deviation per feature value."""
    from demandlens.operators.quantiles import exact_quantiles

    stats = df.groupBy(key).agg(
        F.avg(measure).alias("mean"),
        F.count(measure).alias("count"),
        F.stddev_samp(measure).alias("std"),
    )
    medians = exact_quantiles(df, [measure], [0.5], by=[key])
    medians = medians.select(key, F.col("quantile").alias("median"))
    return stats.join(medians, key).select(F.col(key).alias("feature_value"), "mean", "median", "count", "std")


def spread_ratio(df: DataFrame, key: str, measure: str = "predicted_revenue") -> DataFrame:
    """Mean of the group deviations over the overall deviation."""
    # Partial sums per group would be cheaper than two scans, but the overall deviation
    # of merged groups loses digits; the plain form reads two columns only.
    overall = df.agg(F.stddev_samp(measure)).scalar()
    groups = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.stddev_samp(measure).alias("sd"))
    return groups.agg(F.avg("sd").alias("mean_group_std")).select(
        "mean_group_std",
        overall.alias("overall_std"),
        F.try_divide(F.col("mean_group_std"), overall).alias("ratio"),
    )
