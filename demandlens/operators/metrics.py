"""Forecast quality, residuals, alert rules and model choice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.operators.distribution import histogram

# The default limits of the alert rules.
R2_MIN = 0.7
DRIFT_R2 = 0.9
DRIFT_MAE = 1.1
HIGH_RESIDUAL_SD = 2.0


def metric_columns(actual: Column | str, predicted: Column | str) -> dict[str, Column]:
    """mae, rmse, r2, mape and n as aggregates of one pass; rows lacking a side do not count."""
    y = F.col(actual) if isinstance(actual, str) else actual
    p = F.col(predicted) if isinstance(predicted, str) else predicted
    both = y.isNotNull() & p.isNotNull()
    y, e = F.when(both, y), F.when(both, y - p)
    spread = F.var_pop(y) * F.count(y)
    return {
        "mae": F.avg(F.abs(e)),
        "rmse": F.sqrt(F.avg(e * e)),
        "r2": 1 - F.try_divide(F.sum(e * e), spread),
        "mape": F.avg(F.try_divide(F.abs(e), F.abs(y))),
        "n": F.count(e),
    }


def metrics(
    df: DataFrame, actual: str = "revenue", predicted: str = "predicted_revenue", by: Sequence[str] = ()
) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in metric_columns(actual, predicted).items()])


def long_metrics(wide: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    names = ["mae", "rmse", "r2", "mape"]
    return wide.unpivot(list(by), names, "metric", "value")


def compare_models(df: DataFrame, predictions: Mapping[str, str], actual: str = "revenue") -> DataFrame:
    """Metrics of several prediction columns as a long table (model, metric, value), one pass."""
    cells = []
    for model, column in predictions.items():
        for name, agg in metric_columns(actual, column).items():
            if name != "n":
                cells.append((model, name, agg.cast("double")))
    row = F.array(
        *[F.struct(F.lit(m).alias("model"), F.lit(n).alias("metric"), c.alias("value")) for m, n, c in cells]
    )
    return df.agg(row.alias("r")).select(F.inline("r"))


def best_model(long: DataFrame, metric: str = "mae") -> DataFrame:
    """One row: the model with the lowest value, and all its metrics as its new baseline."""
    lowest = F.min_by(F.col("model"), F.struct(F.col("value"), F.col("model")))
    winner = long.filter(F.col("metric") == metric).agg(lowest.alias("model"))
    return long.join(winner, "model").groupBy("model").pivot("metric", ["mae", "rmse", "r2"]).agg(F.first("value"))


def residual_statistics(df: DataFrame, actual: str = "revenue", predicted: str = "predicted_revenue") -> DataFrame:
    e = F.col(actual) - F.col(predicted)
    return df.agg(F.avg(e).alias("residual_mean"), F.stddev_samp(e).alias("residual_std"), F.count(e).alias("n"))


def high_residuals(
    df: DataFrame,
    actual: str = "revenue",
    predicted: str = "predicted_revenue",
    limit: float = HIGH_RESIDUAL_SD,
) -> DataFrame:
    """Rows whose residual is more than ``limit`` deviations from the mean residual."""
    e = F.col(actual) - F.col(predicted)
    stats = df.agg(F.struct(F.avg(e).alias("m"), F.stddev_samp(e).alias("s")).alias("x")).scalar()
    return df.withColumn("residual", e).filter(F.abs(F.col("residual") - stats["m"]) > limit * stats["s"])


def residual_histogram(
    df: DataFrame, actual: str = "revenue", predicted: str = "predicted_revenue", bins: int = 30
) -> DataFrame:
    return histogram(df.select((F.col(actual) - F.col(predicted)).alias("residual")), "residual", bins)


def alerts(
    current: DataFrame,
    baseline: DataFrame,
    high_residual_count: DataFrame | None = None,
    r2_min: float = R2_MIN,
    mae_max: float | None = None,
) -> DataFrame:
    """Alert rows (level, metric, value, threshold, baseline, message).

    ``current`` and ``baseline`` are one-row tables with ``r2`` and ``mae`` (the baseline
    may be empty). A rule fires when a value breaks its threshold and is also clearly
    worse than the baseline; an absent baseline never fires.
    """
    base = baseline.agg(F.struct(F.first("r2").alias("r2"), F.first("mae").alias("mae")).alias("b")).scalar()
    # Aggregated so that an empty table still yields its one (NULL) row.
    base_r2 = F.coalesce(base["r2"], F.lit(float("-inf")))
    base_mae = F.coalesce(base["mae"], F.lit(float("inf")))
    mae_limit = F.lit(mae_max) if mae_max is not None else base_mae * DRIFT_MAE
    r2, mae = F.col("r2"), F.col("mae")
    four = lambda c: F.format_number(c, 4)
    r2_alert = F.when(
        (r2 < r2_min) & (r2 < base_r2 * DRIFT_R2),
        _alert(
            "ALERT", "r2", r2, F.lit(r2_min), base_r2,
            F.concat(F.lit("R2 ("), four(r2), F.lit(") below threshold and baseline ("), four(base_r2), F.lit(")")),
        ),
    )
    mae_alert = F.when(
        (mae > mae_limit) & (mae > base_mae * DRIFT_MAE),
        _alert(
            "ALERT", "mae", mae, mae_limit, base_mae,
            F.concat(F.lit("MAE ("), four(mae), F.lit(") above threshold and baseline ("), four(base_mae), F.lit(")")),
        ),
    )
    rows = [r2_alert, mae_alert]
    if high_residual_count is not None:
        n = high_residual_count.scalar()
        rows.append(
            F.when(
                n > 0,
                _alert(
                    "WARNING", "high_residuals", n, F.lit(0), F.lit(None),
                    F.concat(n.cast("string"), F.lit(" predictions have high residuals (> 2 std dev)")),
                ),
            )
        )
    return current.select(F.explode(F.array_compact(F.array(*rows))).alias("a")).select("a.*")


def _alert(level: str, metric: str, value: Column, threshold: Column, base: Column, message: Column) -> Column:
    return F.struct(
        F.lit(level).alias("level"),
        F.lit(metric).alias("metric"),
        value.cast("double").alias("value"),
        threshold.cast("double").alias("threshold"),
        base.cast("double").alias("baseline"),
        message.alias("message"),
    )
