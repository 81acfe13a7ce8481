"""Shared parts: document columns, word and window hashes, chunks of bounded size, packed arrays."""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts name it, for Java's and DuckDB's regular expressions.
SPACES = r"[\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, as UTF-8 bytes; a null text is empty."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts; one pass that returns a single number."""
    return docs.select(F.sum(F.octet_length("text"))).first()[0] or 0


def parts(total: int, each: int) -> int:
    return max(1, math.ceil(total / each))


def chunked(docs: DataFrame, chunks: int, by_text: bool = False) -> DataFrame:
    """``texts`` with a chunk number that depends on the id alone, or with ``by_text`` on id and text.

    A chunk is the unit in which a group function holds documents, so its size is bounded by
    the choice of ``chunks``; a document is never cut, so one longer than that is a chunk's whole load.
    Plans that group by it several times share one shuffle of the texts. Rows without an id go by their
    text. With ``by_text`` different texts under one id are spread too; only rows equal in both stay together.
    """
    key = F.xxhash64("doc_id", "text") if by_text else F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    return texts(docs).withColumn("chunk", F.pmod(key, F.lit(chunks)).cast("int"))


class WordHash(dict):
    """64-bit hashes of words, kept for the words seen last; at most ``limit`` of them."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order. Sorting is many times as fast as the hash table of ``np.unique``."""
    held = np.sort(values)
    return held[np.append(True, held[1:] != held[:-1])] if len(held) else held


_ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits under which every bit depends on all others."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    # A power of an odd number per place; runs of doubled width are put together from shorter ones.
    out, done, single, step = None, 0, values.astype(np.uint64), 1
    factor = _ODD
    while step <= width:
        if width & step:
            if out is None:
                out = single
            else:
                size = len(values) - done - step + 1
                out = out[:size] * np.uint64(factor) + single[done : done + size]
            done += step
        if step * 2 <= width:
            single = single[: len(single) - step] * np.uint64(factor) + single[step:]
        factor = factor * factor % 2**64
        step *= 2
    return mix(out[:n])


def pack(values: np.ndarray) -> bytes:
    """An array as bytes, all first bytes before all second ones, so that shuffles compress them."""
    return values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def unpack(data: bytes, dtype=np.uint64) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)
