"""A global row order without a single-task window.

Rows are range-partitioned on the full order key and sorted inside the partitions, so a
day (or any other key) holding a large part of the rows is spread over partitions by the
rest of the key. The sorted table is written once with each row's partition and position:
the sizes of the partitions and the row numbers must come from the same run of the sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlens.session import stage

ROW_BITS = 33  # layout of monotonically_increasing_id: partition above, row below
BLOCK_ROWS = 8_192


def with_row_number(df: DataFrame, order: Sequence[str], name: str = "rn", partitions: int | None = None) -> DataFrame:
    """1-based position of each row in the given order (a total order is expected)."""
    parts = (partitions,) if partitions else ()
    ranged = df.repartitionByRange(*parts, *order).sortWithinPartitions(*order)
    ranged = stage(ranged.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftrightunsigned("_id", ROW_BITS).cast("int")
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per partition of the table above.
    before = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + local + 1)
        .drop("_id", "_part", "_before")
    )


def overlapping_blocks(df: DataFrame, halo: int, rn: str = "rn", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of consecutive rows, each preceded by the last ``halo`` rows of the one before.

    Adds ``_block`` and ``_own`` (false for the copied rows). Windows partitioned by
    ``_block`` and ordered by ``rn`` then see ``halo`` rows back, and the copies are
    dropped afterwards with :func:`own_rows`.
    """
    size = max(block_rows, halo)
    block = F.floor((F.col(rn) - 1) / size)
    tail = (F.col(rn) - 1) % size >= size - halo
    copies = F.when(tail, F.array(block, block + 1)).otherwise(F.array(block))
    marked = df.withColumn("_home", block).withColumn("_block", F.explode(copies))
    return marked.withColumn("_own", F.col("_home") == F.col("_block")).drop("_home")


def block_window(rn: str = "rn") -> Window:
    return Window.partitionBy("_block").orderBy(rn)


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_own", "_block")


def expanding_folds(df: DataFrame, rn: str = "rn", splits: int = 3) -> DataFrame:
    """Expanding-window folds: ``test_fold`` is the fold a row is tested in (NULL: never).

    The n // (splits + 1) rows of fold i come right after all rows it is trained on, so
    fold i trains on the rows whose number is below the first one of that fold.
    """
    n = df.agg(F.max(rn)).scalar()
    size = F.floor(n / (splits + 1))
    first = n - size * splits  # rows before the first test row
    index = F.floor(F.try_divide(F.col(rn) - 1 - first, size)).cast("int")
    return df.withColumn("test_fold", F.when(F.col(rn) > first, index))


def fold_table(df: DataFrame, rn: str = "rn", splits: int = 3) -> DataFrame:
    """(fold, train_rows, test_start, test_rows) of the expanding folds."""
    n = df.agg(F.max(rn).alias("n"))
    size = F.floor(F.col("n") / (splits + 1))
    start = F.col("n") - (splits - F.col("fold")) * size
    return n.select("n", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("fold")).select(
        "fold", start.alias("train_rows"), start.alias("test_start"), size.alias("test_rows")
    )


def fold_filter(fold: int, rows: int, splits: int = 3, rn: str = "rn") -> tuple[Column, Column]:
    """Predicates for the training and the test rows of one fold of ``rows`` rows."""
    size = rows // (splits + 1)
    start = rows - (splits - fold) * size
    return F.col(rn) <= start, (F.col(rn) > start) & (F.col(rn) <= start + size)
