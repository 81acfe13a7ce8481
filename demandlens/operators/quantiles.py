"""Exact quantiles (linear interpolation) that never hold a column in one task.

The built-in ``percentile`` keeps every distinct value of a group in one buffer. Here:

1. one pass builds a bounded sketch per group and takes from it, for every wanted
   probability, an interval that surely holds the two order statistics needed;
2. one pass counts the values below and up to each interval;
3. one pass keeps only the values inside the intervals (about a thousandth of the rows),
   combined by value before they are shuffled, and ranks them slice by slice. An interval
   that is a single value, as on columns with few distinct values, is already the answer.

Groups small enough for it use the interval (min, max). The input is read three times:
stage it first (``session.stage``) when it is itself the result of joins.

Columns are unrolled to (column number, value) rows instead of dozens of aggregates side
by side: those would outgrow what the JVM compiles.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlens.session import stage

ACCURACY = 10_000  # sketch error: 1 / ACCURACY of the rows
MARGIN = 5.0 / ACCURACY  # half-width of the interval, five times that error
SMALL_GROUP = 20_000  # MARGIN * SMALL_GROUP = 10 rows of slack
SLICES = 64


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Long table (by..., column, probability, quantile); groups with a NULL key are left out."""
    keys = [*by, "_c"]
    probabilities = list(probabilities)
    cells = [F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)]
    values = df.select(*by, F.inline(F.array(*cells))).filter(F.col("_v").isNotNull())
    # One row per group and column, written once: three places below read it, and its
    # known size lets the planner decide whether to broadcast it.
    limits = stage(_intervals(values, keys, probabilities), "limits")
    marked = values.join(limits.drop("_n"), keys)
    picks = range(len(probabilities))
    lo, hi = [F.col(f"_lo{k}") for k in picks], [F.col(f"_hi{k}") for k in picks]
    v = F.col("_v")

    counts = marked.groupBy(*keys).agg(
        *[F.count_if(v < lo[k]).alias(f"_below{k}") for k in picks],
        *[F.count_if(v <= hi[k]).alias(f"_upto{k}") for k in picks],
    )
    targets = [
        F.struct(
            F.lit(k).alias("_k"),
            F.lit(p).alias("probability"),
            (p * (F.col("_n") - 1)).alias("_rank"),
            F.col(f"_below{k}").alias("_below"),
            F.col(f"_upto{k}").alias("_upto"),
            F.when(lo[k] == hi[k], lo[k]).alias("_only"),
        )
        for k, p in enumerate(probabilities)
    ]
    counted = counts.join(limits, keys).select(*keys, F.inline(F.array(*targets)))

    inside = [v.between(lo[k], hi[k]) & (lo[k] < hi[k]) for k in picks]
    hits = F.array(
        *[F.when(inside[k], F.struct(F.lit(k).alias("_k"), _slice(v, lo[k], hi[k]).alias("_s"))) for k in picks]
    )
    # A plain predicate first: building arrays for the many rows outside would cost more.
    near = marked.filter(reduce(or_, inside))
    kept = near.select(*keys, "_v", F.explode(F.array_compact(hits)).alias("_h")).select(*keys, "_v", "_h.*")
    per_value = kept.groupBy(*keys, "_k", "_s", "_v").agg(F.count("*").alias("_m"))
    ranked = _ranked(per_value, [*keys, "_k"])

    first, rank = F.col("_first") + F.col("_below"), F.col("_rank")

    def value_at(position: Column) -> Column:
        return F.max(F.when((first <= position) & (position < first + F.col("_m")), v))

    picked = (
        counted.join(ranked, [*keys, "_k"], "left")
        .groupBy(*keys, "probability", "_rank", "_below", "_upto", "_only")
        .agg(value_at(F.floor(rank)).alias("_a"), value_at(F.ceil(rank)).alias("_b"))
    )
    # Both positions lie inside the interval by construction; if a sketch ever broke
    # its bound the job must fail rather than return a wrong value.
    holds = (F.col("_below") <= F.floor(rank)) & (F.ceil(rank) < F.col("_upto"))
    between = F.col("_a") + (F.col("_b") - F.col("_a")) * (rank - F.floor(rank))
    quantile = F.when(holds, F.coalesce("_only", between)).otherwise(
        F.raise_error(F.lit("quantile interval missed its rank")).cast("double")
    )
    names = F.array(*[F.lit(c) for c in columns])
    return picked.select(*by, F.get(names, F.col("_c")).alias("column"), "probability", quantile.alias("quantile"))


def _intervals(values: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    """Per key: number of values, and the interval (lo, hi) of every probability."""
    wanted = sorted({q for p in probabilities for q in (max(p - MARGIN, 0.0), min(p + MARGIN, 1.0))})
    sketch = values.groupBy(*keys).agg(
        F.percentile_approx("_v", wanted, ACCURACY).alias("_s"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.count("_v").alias("_n"),
    )
    small = F.col("_n") <= SMALL_GROUP
    ends: list[Column] = []
    for k, p in enumerate(probabilities):
        lo = F.get("_s", F.lit(wanted.index(max(p - MARGIN, 0.0))))
        hi = F.get("_s", F.lit(wanted.index(min(p + MARGIN, 1.0))))
        ends.append(F.when(small | F.lit(p <= MARGIN), F.col("_min")).otherwise(lo).alias(f"_lo{k}"))
        ends.append(F.when(small | F.lit(p >= 1 - MARGIN), F.col("_max")).otherwise(hi).alias(f"_hi{k}"))
    return sketch.select(*keys, "_n", *ends)


def _slice(v: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.floor((v - lo) / (hi - lo) * SLICES), F.lit(SLICES - 1)).cast("int")


def _ranked(per_value: DataFrame, keys: list[str]) -> DataFrame:
    """0-based position, inside the interval, of the first row of each value.

    The running sum is taken inside a slice, plus the total of the slices before it
    (at most ``SLICES`` rows per key), so no task sorts a whole interval.
    """
    totals = per_value.groupBy(*keys, "_s").agg(F.sum("_m").alias("_t"))
    order = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_s", F.coalesce(F.sum("_t").over(order), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*keys, "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    local = per_value.withColumn("_local", F.coalesce(F.sum("_m").over(inner), F.lit(0)))
    joined = local.join(totals, [*keys, "_s"])
    return joined.select(*keys, "_v", "_m", (F.col("_before") + F.col("_local")).alias("_first"))
