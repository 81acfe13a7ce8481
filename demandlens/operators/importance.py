"""Data-driven feature importance from scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.functions.numeric import clamp
from demandlens.operators.aggregate import pair_correlations, spread_ratio


def data_driven_importance(
    df: DataFrame, numeric: Sequence[str], text: Sequence[str], measure: str = "predicted_revenue"
) -> DataFrame:
    """(feature, importance), normalised to sum 1.

    Numeric: absolute correlation with the prediction. Text: one minus the ratio of the
    mean group deviation to the overall one, held within 0.1 and 0.9. A feature without
    a value (a constant column) stays NULL.
    """
    found = pair_correlations(df, [(c, measure) for c in numeric])
    scores = found.select(F.col("left").alias("feature"), F.abs("r").alias("score"))
    for c in text:
        ratio = spread_ratio(df, c, measure)
        scores = scores.unionByName(
            ratio.select(F.lit(c).alias("feature"), clamp(1 - F.col("ratio"), 0.1, 0.9).alias("score"))
        )
    # One row per feature.
    total = scores.agg(F.sum("score")).scalar()
    return scores.select("feature", F.try_divide(F.col("score"), total).alias("importance"))
