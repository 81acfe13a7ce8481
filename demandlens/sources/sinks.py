"""Table sinks: processed data, series, reports, alerts, baselines, run log, exports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.sources import schemas


def write_processed(df: DataFrame, path: str, date: str | None = "transaction_date", fmt: str = "parquet") -> None:
    """Overwrite a processed table, partitioned by month so that date filters prune files.

    The rows of a month are written by several tasks (the adaptive rebalance splits a
    large month), not funnelled into one.
    """
    writer_df, parts = df, []
    if date is not None:
        writer_df = df.withColumn("month_start", F.trunc(date, "month")).hint("rebalance", "month_start")
        parts = ["month_start"]
    writer = writer_df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.partitionBy(*parts).format(fmt).save(path)


def write_series(df: DataFrame, path: str, measure: str = "revenue") -> None:
    """One CSV file of a daily series (a row per calendar day) with the header Revenue."""
    df.select("date", F.col(measure).alias("Revenue")).coalesce(1).sortWithinPartitions("date").write.mode(
        "overwrite"
    ).option("header", True).csv(path)


def export_csv(df: DataFrame, path: str) -> None:
    """A small result (forecast or summary) as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_report(metrics: DataFrame, path: str, run_id: str, run_date: dt.date) -> None:
    """Long metrics (metric, value) of a run. Rewriting a run replaces its own rows only."""
    _replace_run(metrics.select("metric", "value"), path, run_id, run_date)


def append_alerts(alerts: DataFrame, path: str, run_id: str, run_date: dt.date) -> None:
    _replace_run(alerts, path, run_id, run_date)


def append_high_residuals(rows: DataFrame, path: str, run_id: str, run_date: dt.date) -> None:
    _replace_run(rows, path, run_id, run_date)


def _replace_run(df: DataFrame, path: str, run_id: str, run_date: dt.date) -> None:
    tagged = df.withColumns({"run_date": F.lit(run_date), "run_id": F.lit(run_id)})
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date", "run_id").parquet(
        path
    )


def write_baseline(baseline: DataFrame, path: str) -> None:
    baseline.select("r2", "mae").coalesce(1).write.mode("overwrite").json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """The stored baseline; an empty table when it is missing or unreadable."""
    try:
        stored = spark.read.schema(schemas.BASELINE).json(path)
        return stored.filter(F.col("r2").isNotNull() & F.col("mae").isNotNull())
    except Exception:
        return spark.createDataFrame([], schemas.BASELINE)


def log_run(
    spark: SparkSession, path: str, run_id: str, params: Mapping[str, object], metrics: DataFrame | None = None
) -> None:
    """Append parameters and metrics (model, metric, value) of a run as key-value rows."""
    rows = [("param", str(k), str(v)) for k, v in params.items()]
    out = spark.createDataFrame(rows, "kind string, key string, value string")
    if metrics is not None:
        key = F.concat_ws("_", "model", F.lit("test"), "metric") if "model" in metrics.columns else F.col("metric")
        out = out.unionByName(
            metrics.select(F.lit("metric").alias("kind"), key.alias("key"), F.col("value").cast("string").alias("value"))
        )
    # A partition per run: a run that is repeated replaces its own rows only.
    out = out.withColumns({"run_id": F.lit(run_id), "run_ts": F.current_timestamp()}).coalesce(1)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
