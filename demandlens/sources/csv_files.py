"""CSV folders whose files may have different headers.

Each file's own header says which columns it has and in what order. Files are grouped by
header; a group is read with its own schema, and the groups are put together by name, so
columns never change places and a column that a file lacks is NULL in its rows. The headers
are read file by file on the driver, a few kilobytes each, as the listing of the files is;
the data are read once, by Spark.

Fields are read as text and typed afterwards, so that one bad field does not cost the
record and its reason can be told. A line that has too few or too many fields, or a field
that is not of its column's type, is rejected with its file, its text and the reason.
"""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Headers read at a time.
READERS = 16
FILE, LINE, REASON = "source_file", "line", "reject_reason"
KINDS = {"double": "a number", "float": "a number", "long": "an integer", "integer": "an integer", "date": "a date", "boolean": "true or false"}


def snake(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def list_files(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """The files Spark reads under ``path`` (folders or patterns), empty ones left out."""
    found = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path))
    return sorted(r["path"] for r in found.filter("length > 0").select("path").collect())


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of one file, through whatever store and compression Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(conf).open(where)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(where)
        plain = codec.createInputStream(stream) if codec else stream
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8"), 8192)
        return (reader.readLine() or "").removeprefix("﻿")
    finally:
        stream.close()


def layouts(spark: SparkSession, path: str | Sequence[str], sep: str = ",") -> dict[tuple[str, ...], list[str]]:
    """Files by header. A header that names a column twice (after :func:`snake`) is an error."""
    files = list_files(spark, path)
    with ThreadPoolExecutor(READERS) as pool:
        lines = list(pool.map(lambda f: first_line(spark, f), files))
    out: dict[tuple[str, ...], list[str]] = {}
    for file, line in zip(files, lines):
        header = tuple(next(csv.reader([line], delimiter=sep), ()))
        names = [snake(c) for c in header]
        if len(set(names)) < len(names):
            raise ValueError(f"{file}: a column stands twice in the header")
        out.setdefault(header, []).append(file)
    return out


def read_text_columns(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] = (), sep: str = ",") -> DataFrame:
    """All fields as text under snake-case names, with ``source_file``, ``line`` and ``reject_reason``.

    ``line`` and ``reject_reason`` are set for lines with too few or too many fields. ``columns``
    come first and exist (as NULL) even if no file has them.
    """
    groups = []
    for header, files in layouts(spark, path, sep).items():
        schema = T.StructType([*(T.StructField(c, T.StringType()) for c in header), T.StructField("_bad_line", T.StringType())])
        # Without the pruning of columns a line's fields are counted whichever columns are used.
        reader = spark.read.schema(schema).option("header", True).option("sep", sep).option("enforceSchema", False)
        # A quote within quotes is doubled, as CSV writers do.
        reader = reader.option("quote", '"').option("escape", '"')
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad_line").option("columnPruning", False)
        df = reader.csv(files)
        count = F.when(F.col("_bad_line").isNotNull(), F.lit(f"line does not have {len(header)} fields"))
        groups.append(
            df.select(
                *[F.col(f"`{c}`").alias(snake(c)) for c in header],
                F.col("_metadata.file_path").alias(FILE),
                F.col("_bad_line").alias(LINE),
                count.alias(REASON),
            )
        )
    technical = [FILE, LINE, REASON]
    if not groups:
        empty = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, *technical]])
        return spark.createDataFrame([], empty)
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), groups)
    missing = {c: F.lit(None).cast("string") for c in columns if c not in df.columns}
    df = df.withColumns(missing) if missing else df
    rest = [c for c in df.columns if c not in columns and c not in technical]
    return df.select(*columns, *rest, *technical)


def _typed(column: str, kind: T.DataType) -> Column:
    text = F.when(F.trim(column) != "", F.trim(column))
    if isinstance(kind, T.DateType):
        return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")
    value = text.try_cast(kind)
    return F.when(~F.isnan(value), value) if isinstance(kind, (T.DoubleType, T.FloatType)) else value


def read_typed(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, sep: str = ",") -> DataFrame:
    """The files' columns, those of ``schema`` typed, with ``source_file``, ``line`` and ``reject_reason``.

    An empty field and a number ``NaN`` are NULL; neither is a reason to reject. A rejected row's
    ``line`` is the line as it stands in the file where its fields could not be counted, else
    the values of the fields that were refused.
    """
    df = read_text_columns(spark, path, sep=sep)
    declared = [f for f in schema if f.name in df.columns]
    typed: Mapping[str, Column] = {f.name: _typed(f.name, f.dataType) for f in declared if not isinstance(f.dataType, T.StringType)}
    reasons, refused = [], []
    for f in declared:
        if f.name in typed:
            given = F.trim(f.name)
            nothing = (given == "") | (F.lower(given) == "nan") if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else given == ""
            bad = F.col(f.name).isNotNull() & ~nothing & typed[f.name].isNull()
            reasons.append(F.when(bad, F.lit(f"{f.name}: not {KINDS.get(f.dataType.typeName(), f.dataType.typeName())}")))
            refused.append(F.when(bad, F.concat(F.lit(f"{f.name}="), F.col(f.name))))
    reason, values = F.concat_ws("; ", *reasons), F.concat_ws("; ", *refused)
    told = {
        REASON: F.coalesce(REASON, F.when(reason != "", reason)),
        LINE: F.coalesce(LINE, F.when(values != "", values)),
    }
    # The reasons are told from the text, so they come before the typed columns.
    return df.withColumns(told).withColumns(dict(typed))


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col(REASON).isNull()).drop(FILE, LINE, REASON)


def rejected(df: DataFrame) -> DataFrame:
    """``source_file, line, reject_reason`` of the lines that were refused."""
    return df.filter(F.col(REASON).isNotNull()).select(FILE, LINE, REASON)
