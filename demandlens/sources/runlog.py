"""Compaction of logs that have a folder for each run.

Appending a run writes its own partition, so after a year of runs a log is a million small
files. Compaction puts closed runs together into one version of a second table. A version
counts once Spark has committed it, and a reader takes the newest such version and, of the
runs still in folders of their own, those it does not hold. So each run is seen exactly once
before, during and after a compaction, whether or not the old folders are gone yet. Folders
and versions are removed by the next compaction, when no reader can still be using them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a compacted file, about.
FILE_ROWS = 1_000_000


def _files(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(conf), where


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed versions of the compacted table, in order."""
    fs, pattern = _files(spark, f"{path}_compacted/version=*/_SUCCESS")
    found = fs.globStatus(pattern) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def _compacted(spark: SparkSession, path: str) -> DataFrame | None:
    found = versions(spark, path)
    return spark.read.parquet(f"{path}_compacted/version={found[-1]}") if found else None


def _folders(spark: SparkSession, path: str) -> list:
    """The folders of runs, alone or under their day."""
    fs, _ = _files(spark, path)
    return [s.getPath() for p in ("run_id=*", "*/run_id=*") for s in fs.globStatus(_files(spark, f"{path}/{p}")[1]) or []]


def _live(spark: SparkSession, path: str) -> DataFrame | None:
    if not _folders(spark, path):
        return None
    # Numbers as run ids would lose their zeros if types were inferred.
    key = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        live = spark.read.parquet(path)
    finally:
        spark.conf.set(key, before)
    return live.withColumn("run_date", F.col("run_date").cast("date")) if "run_date" in live.columns else live


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All runs of a log, each once."""
    live, done = _live(spark, path), _compacted(spark, path)
    if live is None and done is None:
        raise FileNotFoundError(f"no log under {path}")
    if done is None or live is None:
        return live if done is None else done
    new = live.join(done.select("run_id").distinct(), "run_id", "left_anti")
    return done.unionByName(new, allowMissingColumns=True)


def compact(spark: SparkSession, path: str, closed_before: dt.date | None = None) -> int:
    """Put closed runs into a new version and return its number.

    ``closed_before``: only runs of earlier days (logs without ``run_date``: by ``run_ts``).
    Of a run that was compacted before, the compacted rows stay.
    """
    found, done = versions(spark, path), _compacted(spark, path)
    held = done.select("run_id").distinct() if done is not None else None
    live = _live(spark, path)
    if live is not None and closed_before is not None:
        day = F.col("run_date") if "run_date" in live.columns else F.to_date("run_ts")
        live = live.filter(day < F.lit(closed_before))
    if live is not None and held is not None:
        live = live.join(held, "run_id", "left_anti")
    parts = [t for t in (done, live) if t is not None]
    if not parts:
        raise FileNotFoundError(f"no log under {path}")
    rows = parts[0].unionByName(parts[1], allowMissingColumns=True) if len(parts) == 2 else parts[0]
    number = found[-1] + 1 if found else 1
    writer = rows.hint("rebalance", "run_id").write.option("maxRecordsPerFile", FILE_ROWS).mode("overwrite")
    writer.parquet(f"{path}_compacted/version={number}")
    _clear(spark, path, found, held)
    return number


def _clear(spark: SparkSession, path: str, found: list[int], held: DataFrame | None) -> None:
    """Remove what the newest version has replaced since an earlier compaction."""
    fs, _ = _files(spark, path)
    for old in found[:-1]:
        fs.delete(_files(spark, f"{path}_compacted/version={old}")[1], True)
    if held is None:
        return
    # As many names as there were runs between two compactions.
    gone = {r["run_id"] for r in held.join(_run_names(spark, path), "run_id", "left_semi").collect()}
    for folder in _folders(spark, path):
        if folder.getName().split("=", 1)[1] in gone:
            fs.delete(folder, True)


def _run_names(spark: SparkSession, path: str) -> DataFrame:
    live = _live(spark, path)
    return live.select("run_id").distinct() if live is not None else spark.createDataFrame([], "run_id string")
