"""Intervals of grouped means by a Poisson bootstrap.

In each replicate a row counts 0, 1, 2, … times, a Poisson number with mean 1. The numbers
come from hashes of the row's key, so they are the same in every run, in any order and on
any number of machines. Each batch of rows is hashed and added up where it lies, all replicates
at once; what is sent are the sums of its groups, so no row is drawn, multiplied or sent.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5
from itertools import accumulate
from math import exp, factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPLICATES = 48
#: Numbers of 16 bits in a hash.
EACH = 8
#: The smallest number of each count from 1 on, of 65,536.
STEPS = [round(65_536 * p) for p in accumulate(exp(-1) / factorial(k) for k in range(9))]


def weights(keys: Sequence[Column], replicates: int = REPLICATES, seed: int = 0) -> Column:
    """One Poisson number for each replicate, from the hashes of a row's key."""
    text = F.concat_ws("|", *[k.cast("string") for k in keys])
    blocks = -(-replicates // EACH)
    hashes = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.md5(F.concat_ws("|", F.lit(str(seed)), b.cast("string"), text)))
    numbers = F.flatten(
        F.transform(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.lit(EACH - 1)), lambda i: F.conv(F.substring(h, 4 * i + 1, F.lit(4)), 16, 10).cast("int")))
    )
    count = lambda u: sum((F.when(u >= s, 1).otherwise(0) for s in STEPS), F.lit(0))
    return F.slice(F.transform(numbers, count), 1, replicates)


def drawn_counts(texts: Sequence[str], replicates: int, seed: int) -> np.ndarray:
    """(rows, replicates): the numbers of :func:`weights` for the joined keys of many rows."""
    blocks = -(-replicates // EACH)
    starts = [f"{seed}|{b}|".encode() for b in range(blocks)]
    digests = b"".join([md5(s + t).digest() for t in map(str.encode, texts) for s in starts])
    numbers = np.frombuffer(digests, ">u2").reshape(len(texts), blocks * EACH)[:, :replicates]
    return np.searchsorted(STEPS, np.arange(65_536), side="right")[numbers]


def _groups(columns: Sequence[pa.Array], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows in an order by group, and where in it each group starts; NULL is a value."""
    code = np.zeros(rows, np.int64)
    for column in columns:
        each = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        # Made dense again after each column, so that the product stays below rows squared.
        code = np.unique(code * (int(each.max()) + 1) + each, return_inverse=True)[1].reshape(-1)
    order = np.argsort(code, kind="stable")
    return order, np.flatnonzero(np.diff(code[order], prepend=-1))


def mean_interval(
    df: DataFrame,
    by: Sequence[str],
    measure: str,
    keys: Sequence[str],
    level: float = 0.95,
    replicates: int = REPLICATES,
    seed: int = 0,
) -> DataFrame:
    """(by..., n, mean, lower, upper): the mean and the quantiles of its replicates.

    ``keys`` tell rows apart; rows that share them count alike in every replicate.
    """
    known = df.filter(F.col(measure).isNotNull())
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    narrow = known.select(*by, F.col(measure).cast("double").alias("_x"), text.alias("_key"))
    width = len(by)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(width).to_numpy(zero_copy_only=False)
            order, starts = _groups(batch.columns[:width], batch.num_rows)
            w = drawn_counts(batch.column(width + 1).to_pylist(), replicates, seed)[order]
            rows = np.diff(starts, append=batch.num_rows)
            lists = lambda values: pa.ListArray.from_arrays(
                pa.array(np.arange(len(starts) + 1, dtype=np.int32) * replicates), pa.array(values.reshape(-1))
            )
            sums = [lists(np.add.reduceat(w * x[order, None], starts, axis=0)), lists(np.add.reduceat(w, starts, axis=0))]
            plain = [pa.array(np.add.reduceat(x[order], starts)), pa.array(rows.astype(np.int64))]
            firsts = pa.array(order[starts])
            yield pa.RecordBatch.from_arrays([*(c.take(firsts) for c in batch.columns[:width]), *sums, *plain], names=schema.names)

    fields = [T.StructField("_sums", T.ArrayType(T.DoubleType())), T.StructField("_counts", T.ArrayType(T.LongType()))]
    fields += [T.StructField("_total", T.DoubleType()), T.StructField("_number", T.LongType())]
    schema = T.StructType([*narrow.schema.fields[:width], *fields])
    parts = narrow.mapInArrow(add, schema)
    # A replicate 0 carries the mean itself.
    first = lambda c: F.when(F.col("_r") == 0, F.col(c)).alias(c)
    drawn = parts.select(*by, "_total", "_number", F.posexplode(F.arrays_zip("_sums", "_counts")).alias("_r", "_w"))
    drawn = drawn.select(*by, "_r", "_w.*", first("_total"), first("_number"))
    sums = drawn.groupBy(*by, "_r").agg(
        F.sum("_sums").alias("_s"), F.sum("_counts").alias("_n"), F.sum("_total").alias("_all"), F.sum("_number").alias("_rows")
    )
    value = F.when(F.col("_n") > 0, F.col("_s") / F.col("_n"))
    tail = (1 - level) / 2
    # At most one row per group and replicate.
    return sums.groupBy(*by).agg(
        F.sum("_rows").alias("n"),
        (F.sum("_all") / F.sum("_rows")).alias("mean"),
        F.percentile(value, F.lit(tail)).alias("lower"),
        F.percentile(value, F.lit(1 - tail)).alias("upper"),
    )
