"""Exact duplicates: frequent digests are found by Misra-Gries and removed map-side, the rest by a shuffle.

Texts are equal when they are identical after each run of ASCII white space became one space.

Defined cases: a null text is empty; all empty texts form one group. Rows without an id come last, so
one of them stays only where no equal text has an id. Repeated rows (same id and text) count in
``group_size``; exactly one row of a group stays. Empty tables give empty results. Only ``doc_id`` and
``text`` are read by ``duplicates``; ``drop_duplicates`` returns the rows with all columns as they are,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from demandlens.llm.common import SPACES
from demandlens.session import stage

#: A digest is a heavy hitter when more than one row in HEAVY has it. Each task's summary has four
#: times as many counters, so a heavy one is undercounted by a quarter of that limit at most.
HEAVY = 256


def digest(text: str) -> F.Column:
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " "), 256)


def misra_gries(counters: int):
    """For ``mapInPandas`` over one column of keys: at most ``counters`` keys a task, with lower bounds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = pd.Series(dtype="int64")
        for batch in batches:
            counts = counts.add(batch.iloc[:, 0].value_counts(), fill_value=0).astype("int64")
            if len(counts) > counters:
                # What the first counter beyond the limit holds is taken from all, as if that many
                # groups of different keys had been struck out.
                counts = counts - counts.nlargest(counters + 1).iloc[-1]
                counts = counts[counts > 0]
        yield pd.DataFrame({"digest": counts.index.astype("str"), "at_least": counts.to_numpy("int64")})

    return run


def heavy_hitters(rows: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """``digest, keep, group_size`` of the digests that more than one row in ``heavy`` has.

    ``rows`` is ``digest, doc_id, row``, staged. At most ``heavy`` rows come out, so the result may be
    broadcast at any input size. Candidates are verified by exact counts.
    """
    few = (
        rows.select("digest")
        .mapInPandas(misra_gries(4 * heavy), "digest string, at_least long")
        .groupBy("digest")
        .agg(F.sum("at_least").alias("at_least"))
        .orderBy(F.desc("at_least"), "digest")
        .limit(2 * heavy)
        .select("digest")
    )
    n = rows.count()
    counted = rows.join(F.broadcast(few), "digest").groupBy("digest").agg(*_group())
    return counted.filter(F.col("group_size") * heavy > n)


def _order() -> F.Column:
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")


def _group() -> list[F.Column]:
    return [F.min(_order()).alias("keep"), F.count("*").alias("group_size")]


def duplicates(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Per row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = stage(docs.select("doc_id", digest("text").alias("digest"), F.monotonically_increasing_id().alias("row")))
    winners = F.broadcast(stage(heavy_hitters(rows, heavy)))
    hot = rows.join(winners, "digest")
    cold = rows.join(winners.select("digest"), "digest", "left_anti")
    # The counts are put together before the shuffle; the join reuses their partitioning.
    cold = cold.join(cold.groupBy("digest").agg(*_group()), "digest")
    return hot.unionByName(cold).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """The rows of ``docs`` that stay. Rows of heavy digests go map-side; the others are shuffled once."""
    rows = stage(docs.select("doc_id", digest("text").alias("digest"), F.monotonically_increasing_id().alias("row")))
    winners = F.broadcast(
        stage(heavy_hitters(rows, heavy)).select(F.col("digest").alias("hot"), F.col("keep.doc_id").alias("id"))
    )
    # All columns travel in one struct, so that no name can clash.
    packed = docs.select(digest("text").alias("digest"), F.struct("*").alias("doc"))
    left = packed.join(winners, F.col("digest") == F.col("hot"), "left").filter(
        F.col("hot").isNull() | F.col("doc.doc_id").eqNullSafe(F.col("id"))
    )
    first = F.row_number().over(W.partitionBy("digest").orderBy(F.col("doc.doc_id").asc_nulls_last()))
    return left.withColumn("n", first).filter("n = 1").select("doc.*")
