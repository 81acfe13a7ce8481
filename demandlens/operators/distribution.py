"""Histograms, box-plot statistics and table profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.operators.quantiles import exact_quantiles


def bin_index(x: Column, low: Column, high: Column, bins: Column | int) -> Column:
    """0-based bin, the last one closed on the right; one bin when all values are equal."""
    n = bins if isinstance(bins, Column) else F.lit(bins)
    return F.when(high == low, F.lit(0)).otherwise(
        F.least(F.floor((x - low) / (high - low) * n), n - 1).cast("int")
    )


def histogram(df: DataFrame, measure: str = "revenue", bins: int = 30, subset: Column | None = None) -> DataFrame:
    """Counts and percent per bin; with ``subset`` also those of the rows it selects.

    Only bins with rows are returned.
    """
    flag = F.lit(True) if subset is None else F.coalesce(subset, F.lit(False))
    present = df.select(F.col(measure).alias("x"), flag.alias("in_subset")).filter(F.col("x").isNotNull())
    edges = present.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("e")).scalar()
    binned = present.withColumn("bin", bin_index(F.col("x"), edges["lo"], edges["hi"], bins))
    counts = binned.groupBy("bin").agg(
        F.count("*").alias("count"), F.count_if("in_subset").alias("subset_count")
    )
    # One row per bin: the totals are those of at most `bins` rows.
    totals = counts.agg(F.struct(F.sum("count").alias("n"), F.sum("subset_count").alias("m")).alias("t")).scalar()
    width = (edges["hi"] - edges["lo"]) / F.lit(bins)
    out = counts.select(
        "bin",
        (edges["lo"] + F.col("bin") * width).alias("bin_start"),
        "count",
        (F.try_divide(F.col("count").cast("double"), totals["n"]) * 100).alias("percent"),
        *(
            []
            if subset is None
            else [
                "subset_count",
                (F.try_divide(F.col("subset_count").cast("double"), totals["m"]) * 100).alias("subset_percent"),
            ]
        ),
    )
    return out


def automatic_bins(df: DataFrame, measure: str = "revenue") -> DataFrame:
    """Bin count from the narrower of the Freedman-Diaconis and Sturges widths (one row)."""
    iqr = exact_quantiles(df, [measure], [0.25, 0.75]).agg((F.max("quantile") - F.min("quantile")).alias("iqr"))
    stats = df.agg(F.count(measure).alias("n"), F.min(measure).alias("lo"), F.max(measure).alias("hi"))
    span = F.col("hi") - F.col("lo")
    sturges = span / (F.log2(F.col("n")) + 1)
    fd = 2 * F.col("iqr") / F.cbrt(F.col("n"))
    width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    return (
        stats.withColumn("iqr", iqr.scalar())
        .withColumn("width", width)
        .withColumn("bins", F.when(F.col("width") > 0, F.ceil(span / F.col("width")).cast("int")).otherwise(1))
        .select("n", "iqr", "width", "bins")
    )


def histogram_auto(df: DataFrame, measure: str = "revenue") -> DataFrame:
    bins = automatic_bins(df, measure).select("bins").first()[0]  # one number
    return histogram(df, measure, bins)


def box_statistics(df: DataFrame, key: str, measure: str = "revenue", reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (furthest values inside the fences) and outliers per group."""
    long = exact_quantiles(df, [measure], [0.25, 0.5, 0.75], by=[key])
    at = lambda p: F.max(F.when(F.col("probability") == p, F.col("quantile")))
    quartiles = long.groupBy(key).agg(at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    inside = F.col(measure).between(F.col("q1") - reach * iqr, F.col("q3") + reach * iqr)
    # The quartile table has one row per group; its size decides how it is joined.
    return (
        df.select(key, measure)
        .join(quartiles, key)
        .groupBy(key, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(measure))).alias("whisker_low"),
            F.max(F.when(inside, F.col(measure))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
            F.count(measure).alias("n"),
        )
    )


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per numeric column."""
    wide = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.count(c).alias("count"),
                    F.avg(c).alias("mean"),
                    F.stddev_samp(c).alias("std"),
                    F.min(c).cast("double").alias("min"),
                    F.max(c).cast("double").alias("max"),
                )
                for c in columns
            ]
        ).alias("s")
    ).select(F.inline("s"))
    long = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    at = lambda p: F.max(F.when(F.col("probability") == p, F.col("quantile")))
    quartiles = long.groupBy("column").agg(at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))
    return wide.join(quartiles, "column")


def text_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, unique, most frequent value (first in order on ties) and its count."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = (
        df.select(F.inline(cells))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )
    top = F.min_by(F.col("value"), F.struct(-F.col("n"), F.col("value")))
    return counts.groupBy("column").agg(
        F.sum("n").alias("count"), F.count("*").alias("unique"), top.alias("top"), F.max("n").alias("freq")
    )
