"""Checking a deployed model on new data: metrics, alerts and reports as tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.operators import metrics
from demandlens.sources import sinks


@dataclass
class Check:
    metrics: DataFrame
    alerts: DataFrame
    high_residuals: DataFrame


def check(
    scored: DataFrame,
    baseline: DataFrame,
    actual: str = "revenue",
    predicted: str = "predicted_revenue",
    r2_min: float = metrics.R2_MIN,
    mae_max: float | None = None,
) -> Check:
    """Metrics, fired alerts and high residuals of scored rows with known revenue.

    Both sides are in money units. Without any known revenue there are no alerts.
    """
    known = scored.filter(F.col(actual).isNotNull())
    current = metrics.metrics(known, actual, predicted)
    high = metrics.high_residuals(known, actual, predicted)
    fired = metrics.alerts(current, baseline, high.agg(F.count("*")), r2_min, mae_max)
    return Check(current, fired, high)


def write_check(result: Check, path: str, run_id: str, run_date: dt.date) -> None:
    """Append the run to the report, alert, residual and run-log tables (idempotent by run id)."""
    spark = result.metrics.sparkSession
    long = metrics.long_metrics(result.metrics)
    sinks.append_report(long, f"{path}/reports", run_id, run_date)
    sinks.append_alerts(result.alerts, f"{path}/alerts", run_id, run_date)
    sinks.append_high_residuals(result.high_residuals, f"{path}/high_residuals", run_id, run_date)
    sinks.log_run(spark, f"{path}/runs", run_id, {"kind": "monitoring", "run_date": run_date}, long)
