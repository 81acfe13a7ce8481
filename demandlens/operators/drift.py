"""Has a population changed? Kolmogorov-Smirnov distances and population stability indexes.

Both compare a baseline with current rows, column by column. Values are counted first
(combined map-side), so a value that a third of the rows have is one row from then on.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlens.operators.ordering import ROW_BITS
from demandlens.operators.quantiles import exact_quantiles
from demandlens.session import stage

BINS, SMOOTHING = 10, 0.5
MISSING = "(missing)"
# Up to where an index counts as stable, and as a moderate shift.
STABLE, MODERATE = 0.1, 0.25
#: Terms of the limit distribution's series; below this distance it is 1 to nine digits.
TERMS, NEAR_ZERO = 100, 0.2


def _number(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def _values(df: DataFrame, columns: Sequence[str], side: str) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), _number(c).alias("value")) for c in columns]
    long = df.select(F.inline(F.array(*cells))).filter(F.col("value").isNotNull())
    counted = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    other = {"base": "current", "current": "base"}[side]
    return counted.select("column", "value", F.col("n").alias(side), F.lit(0).cast("long").alias(other))


def kolmogorov(distance: Column) -> Column:
    """Chance of at least this scaled distance if nothing changed (limit distribution)."""
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(TERMS)),
        lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * distance * distance),
    )
    total = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    return F.when(distance < NEAR_ZERO, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def ks_distances(baseline: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, base_rows, current_rows, distance, p_value); columns empty on one side are left out.

    The two empirical distributions are running sums over the distinct values in order. These
    are range-partitioned over all columns together; each range sums on its own and adds what
    lies before it, so no task holds a column.
    """
    both = _values(baseline, columns, "base").unionByName(_values(current, columns, "current"))
    counts = both.groupBy("column", "value").agg(F.sum("base").alias("base"), F.sum("current").alias("current"))
    ranged = counts.repartitionByRange("column", "value").sortWithinPartitions("column", "value")
    ranged = stage(ranged.withColumn("range", F.shiftrightunsigned(F.monotonically_increasing_id(), ROW_BITS).cast("int")), "ranges")
    # One row per range and column that it touches.
    sums = ranged.groupBy("column", "range").agg(F.sum("base").alias("base"), F.sum("current").alias("current"))
    before = Window.partitionBy("column").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("column")
    offsets = sums.select(
        "column",
        "range",
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before") for s in ("base", "current")],
        *[F.sum(s).over(whole).alias(f"{s}_rows") for s in ("base", "current")],
    )
    running = Window.partitionBy("column", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumns({f"{s}_here": F.sum(s).over(running) for s in ("base", "current")})
    at = summed.join(offsets, ["column", "range"]).filter("base_rows > 0 AND current_rows > 0")
    share = lambda s: (F.col(f"{s}_here") + F.col(f"{s}_before")) / F.col(f"{s}_rows")
    out = at.groupBy("column").agg(
        F.first("base_rows").alias("base_rows"),
        F.first("current_rows").alias("current_rows"),
        F.max(F.abs(share("base") - share("current"))).alias("distance"),
    )
    n, m = F.col("base_rows").cast("double"), F.col("current_rows").cast("double")
    return out.withColumn("p_value", kolmogorov(F.sqrt(n * m / (n + m)) * F.col("distance")))


def fit_edges(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """Inner edges of bins with equal shares of ``df``; equal edges are one. Kept as fitted state."""
    found = exact_quantiles(df.withColumns({c: _number(c) for c in columns}), columns, [i / bins for i in range(1, bins)])
    rows = found.groupBy("column").agg(F.sort_array(F.collect_set("quantile")).alias("edges")).collect()  # one row per column
    return {r["column"]: [float(e) for e in r["edges"] if e is not None] for r in rows}


def _bin(column: str, edges: Sequence[float]) -> Column:
    """How many edges lie below the value, as text; all equal and smaller values are in one bin."""
    value = _number(column)
    below = sum((F.when(value > e, 1).otherwise(0) for e in edges), F.lit(0))
    return F.when(value.isNull(), F.lit(MISSING)).otherwise(below.cast("string"))


def cell_counts(df: DataFrame, edges: Mapping[str, Sequence[float]], categorical: Sequence[str] = ()) -> DataFrame:
    """(column, cell, n): rows per bin of numeric columns and per value of categorical ones."""
    cells = [F.struct(F.lit(c).alias("column"), _bin(c, e).alias("cell")) for c, e in edges.items()]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
    cells += [F.struct(F.lit(c).alias("column"), text(c).alias("cell")) for c in categorical]
    return df.select(F.inline(F.array(*cells))).groupBy("column", "cell").agg(F.count("*").alias("n"))


def stability_cells(
    baseline: DataFrame,
    current: DataFrame,
    edges: Mapping[str, Sequence[float]],
    categorical: Sequence[str] = (),
    smoothing: float = SMOOTHING,
) -> DataFrame:
    """(column, cell, base_share, current_share, part) over all cells that either side has.

    ``smoothing`` is added to every count, so that a cell empty on one side has a share.
    """
    sides = [cell_counts(df, edges, categorical).withColumnRenamed("n", n) for df, n in ((baseline, "base"), (current, "now"))]
    both = sides[0].join(sides[1], ["column", "cell"], "full").fillna(0, ["base", "now"])
    # One row per cell of a column: as many as bins, or as the column has values.
    totals = both.groupBy("column").agg(F.sum("base").alias("bases"), F.sum("now").alias("nows"), F.count("*").alias("cells"))
    share = lambda n, total: (F.col(n) + smoothing) / (F.col(total) + smoothing * F.col("cells"))
    out = both.join(totals, "column").select(
        "column", "cell", share("base", "bases").alias("base_share"), share("now", "nows").alias("current_share")
    )
    gap = F.col("current_share") - F.col("base_share")
    return out.withColumn("part", gap * F.log(F.col("current_share") / F.col("base_share")))


def stability_index(cells: DataFrame) -> DataFrame:
    """(column, psi, level) from :func:`stability_cells`."""
    out = cells.groupBy("column").agg(F.sum("part").alias("psi"))
    level = F.when(F.col("psi") < STABLE, "stable").when(F.col("psi") < MODERATE, "moderate").otherwise("shifted")
    return out.withColumn("level", level)
