"""Fitted feature preparation: every step is a fit (statistics) and an apply (projection).

Fitted statistics are a few numbers per column and a bounded list of category values.
They are held as plain values, written as small tables, and applied as literals, so the
same projection serves training, batch scoring and streams.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.functions import calendar as cal
from demandlens.functions import numeric as num
from demandlens.operators import drift, impute
from demandlens.operators import select as sel
from demandlens.operators.aggregate import correlation_pairs
from demandlens.operators.quantiles import exact_quantiles
from demandlens.session import stage

# How each column is treated.
CATEGORICAL = ("category", "region")
LOG_COLUMNS = ("ad_spend", "revenue", "conversion_rate")
MINMAX_COLUMNS = ("discount_applied", "clicks", "impressions", "ad_ctr", "ad_cpc")
OUTLIER_EXEMPT = ("revenue", "units_sold")
CORRELATION_LIMIT = 0.8
MAX_CATEGORIES = 1_000

STATS_SCHEMA = "column string, min double, max double, q1 double, median double, q3 double, lower double, upper double"
CATEGORY_SCHEMA = "column string, value string, position int"
META_SCHEMA = "key string, position int, value string"
EDGE_SCHEMA = "column string, position int, edge double"


@dataclass
class Preparation:
    """Fitted state of the cleaning steps and of the feature list.

    ``imputation`` (if values are filled in) stays a table: it has a row for each group.
    """

    categories: dict[str, list[str]] = field(default_factory=dict)
    outliers: dict[str, dict[str, float]] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    log_columns: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    feature_columns: list[str] = field(default_factory=list)
    edges: dict[str, list[float]] = field(default_factory=dict)
    imputed: list[str] = field(default_factory=list)
    imputation: DataFrame | None = None

    def save(self, spark: SparkSession, path: str) -> None:
        columns = sorted({*self.outliers, *self.ranges})
        stats = []
        for c in columns:
            o, r = self.outliers.get(c, {}), self.ranges.get(c, (None, None))
            stats.append((c, r[0], r[1], *[o.get(k) for k in ("q1", "median", "q3", "lower", "upper")]))
        cats = [(c, v, i) for c, vs in self.categories.items() for i, v in enumerate(vs)]
        lists = {"log": self.log_columns, "dropped": self.dropped, "feature": self.feature_columns, "imputed": self.imputed}
        edges = [(c, i, e) for c, es in self.edges.items() for i, e in enumerate(es)]
        if self.imputation is not None:
            self.imputation.write.mode("overwrite").parquet(f"{path}/fit_imputation")
        meta = [(k, i, v) for k, vs in lists.items() for i, v in enumerate(vs)]
        for name, rows, schema in (
            ("fit_stats", stats, STATS_SCHEMA),
            ("fit_categories", cats, CATEGORY_SCHEMA),
            ("fit_meta", meta, META_SCHEMA),
            ("fit_edges", edges, EDGE_SCHEMA),
        ):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Preparation:
        """Fails with the name of the part when one is missing."""
        parts = {}
        for name in ("fit_stats", "fit_categories", "fit_meta", "fit_edges"):
            try:
                # Fitted state: one row per column, category value or list entry.
                parts[name] = spark.read.parquet(f"{path}/{name}").collect()
            except Exception as exc:
                raise FileNotFoundError(f"fitted state lacks {name} under {path}") from exc
        out = Preparation()
        for row in sorted(parts["fit_categories"], key=lambda r: (r["column"], r["position"])):
            out.categories.setdefault(row["column"], []).append(row["value"])
        for row in parts["fit_stats"]:
            if row["median"] is not None:
                out.outliers[row["column"]] = {k: row[k] for k in ("q1", "median", "q3", "lower", "upper")}
            if row["min"] is not None:
                out.ranges[row["column"]] = (row["min"], row["max"])
        for row in sorted(parts["fit_edges"], key=lambda r: (r["column"], r["position"])):
            out.edges.setdefault(row["column"], []).append(row["edge"])
        lists = {"log": out.log_columns, "dropped": out.dropped, "feature": out.feature_columns, "imputed": out.imputed}
        for row in sorted(parts["fit_meta"], key=lambda r: r["position"]):
            lists[row["key"]].append(row["value"])
        if out.imputed:
            out.imputation = spark.read.parquet(f"{path}/fit_imputation")
        return out


# --- correlation filter ---------------------------------------------------------------


def correlated_columns(df: DataFrame, columns: Sequence[str], limit: float = CORRELATION_LIMIT) -> DataFrame:
    """Columns to drop: the later one of every pair whose (signed) correlation is above the limit."""
    high = correlation_pairs(df, columns).filter(F.col("r") > limit)
    return high.groupBy(F.col("right").alias("column")).agg(F.max("r").alias("max_r"))


# --- one-hot ---------------------------------------------------------------------------


def fit_categories(df: DataFrame, columns: Sequence[str] = CATEGORICAL) -> dict[str, list[str]]:
    """Sorted distinct values per column; more than ``MAX_CATEGORIES`` is an error."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    found = df.select(F.inline(cells)).filter(F.col("value").isNotNull()).distinct()
    # One row more than allowed is enough to see that there are too many.
    rows = found.limit(MAX_CATEGORIES * len(columns) + 1).collect()
    out: dict[str, list[str]] = {c: [] for c in columns}
    for row in rows:
        out[row["column"]].append(row["value"])
    for c, values in out.items():
        if len(values) > MAX_CATEGORIES:
            raise ValueError(f"{c}: more than {MAX_CATEGORIES} categories cannot be one-hot encoded")
        values.sort()
    return out


def one_hot(categories: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """``<column>_<value>`` flags; an unknown or absent value gives all zeros."""
    return {
        f"{c}_{v}": F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0))
        for c, values in categories.items()
        for v in values
    }


def unseen_values(df: DataFrame, categories: Mapping[str, Sequence[str]]) -> DataFrame:
    """(column, value, rows) of values absent at fit time."""
    cells, known = [], F.lit(False)
    for c, values in categories.items():
        cells.append(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")))
        known = known | ((F.col("column") == c) & F.col("value").isin(list(values)))
    long = df.select(F.inline(F.array(*cells))).filter(F.col("value").isNotNull() & ~known)
    return long.groupBy("column", "value").agg(F.count("*").alias("rows"))


# --- outliers --------------------------------------------------------------------------


def outlier_limits(df: DataFrame, columns: Sequence[str], reach: float = 1.5) -> DataFrame:
    """(column, q1, median, q3, lower, upper), all columns in the same passes."""
    long = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    at = lambda p: F.max(F.when(F.col("probability") == p, F.col("quantile")))
    wide = long.groupBy("column").agg(at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return wide.withColumns({"lower": F.col("q1") - reach * iqr, "upper": F.col("q3") + reach * iqr})


def fit_outliers(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, float]]:
    rows = outlier_limits(df, columns).collect()  # one row per column
    return {r["column"]: {k: r[k] for k in ("q1", "median", "q3", "lower", "upper")} for r in rows}


def replace_outliers(limits: Mapping[str, Mapping[str, float]]) -> dict[str, Column]:
    """Values outside the fences become the median."""
    out = {}
    for c, s in limits.items():
        outside = (F.col(c) < s["lower"]) | (F.col(c) > s["upper"])
        out[c] = F.when(outside, F.lit(s["median"])).otherwise(F.col(c))
    return out


# --- scaling ---------------------------------------------------------------------------


def fit_ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    if not columns:
        return {}
    row = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in columns if row[f"lo_{c}"] is not None}


def scale_ranges(ranges: Mapping[str, tuple[float, float]]) -> dict[str, Column]:
    return {c: num.min_max(c, lo, hi) for c, (lo, hi) in ranges.items()}


def log_scale(columns: Sequence[str]) -> dict[str, Column]:
    return {c: num.log1p_clamped(c) for c in columns}


# --- the whole cleaning sequence -------------------------------------------------------


def rounded_base(df: DataFrame, dropped: Sequence[str], floats: Sequence[str]) -> DataFrame:
    """Correlated columns removed, float columns rounded to two digits."""
    out = sel.drop_columns(df, dropped)
    return out.withColumns({c: num.round_half_even(c, 2) for c in floats if c in out.columns})


def fit_preparation(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str] = CATEGORICAL,
    dropped: Sequence[str] | None = sel.CORRELATED_COLUMNS,
    include_onehot: bool = False,
    imputed: Sequence[str] = (),
    bins: int = 0,
) -> Preparation:
    """Fit all cleaning steps on training rows.

    ``imputed`` columns are filled in first, from the means of their groups. With ``bins`` the
    edges that :mod:`drift` compares later populations by are fitted on the raw columns.
    ``dropped=None`` finds the correlated columns from the data. ``include_onehot``
    also runs the outlier step over the one-hot flags, which wipes out every category
    with a share under a quarter; off by default.
    """
    if dropped is None:
        found = correlated_columns(df, list(numeric)).select("column").collect()  # at most one row per column
        dropped = sorted(r[0] for r in found)
    prep = Preparation(dropped=list(dropped), imputed=list(imputed))
    if bins:
        prep.edges = drift.fit_edges(df, list(numeric), bins)
    if imputed:
        prep.imputation = stage(impute.fit_imputer(df, imputed), "imputation")
        df = impute.apply_imputer(df, prep.imputation, imputed)
    left = [c for c in numeric if c not in dropped]
    base = rounded_base(df, dropped, left)
    prep.categories = fit_categories(base, categorical)
    treated = [c for c in left if c not in OUTLIER_EXEMPT]
    if include_onehot:
        flags = one_hot(prep.categories)
        base = base.withColumns(flags)
        treated += list(flags)
    prep.outliers = fit_outliers(base, treated)
    prep.log_columns = [c for c in LOG_COLUMNS if c in left]
    # The outlier step only moves values to the median, so the range is that of the
    # treated column; one more aggregate over the same columns.
    scaled = [c for c in MINMAX_COLUMNS if c in left]
    prep.ranges = fit_ranges(base.select([v.alias(k) for k, v in replace_outliers(prep.outliers).items()]), scaled)
    return prep


def apply_cleaning(
    df: DataFrame, prep: Preparation, numeric: Sequence[str], outliers: bool = True, encode: bool = True
) -> DataFrame:
    """Fill in, round, encode, treat outliers, scale: narrow projections, but for the imputation's small joins.

    Without ``encode`` the category columns stay as they are, to be encoded by :func:`encoded` later.
    """
    if prep.imputation is not None:
        df = impute.apply_imputer(df, prep.imputation, prep.imputed)
    left = [c for c in numeric if c not in prep.dropped and c in df.columns]
    out = rounded_base(df, prep.dropped, left)
    if encode:
        out = out.withColumns(one_hot(prep.categories))
    if outliers:
        present = {c: s for c, s in prep.outliers.items() if c in out.columns}
        out = out.withColumns(replace_outliers(present))
    scaled = {**log_scale([c for c in prep.log_columns if c in out.columns])}
    scaled.update(scale_ranges({c: r for c, r in prep.ranges.items() if c in out.columns}))
    out = out.withColumns(scaled)
    return out.drop(*prep.categories) if encode else out


def encoded(prep: Preparation) -> dict[str, Column]:
    """The one-hot flags of rows cleaned without them, outliers among the flags treated if they were fitted."""
    out = one_hot(prep.categories)
    for c, s in prep.outliers.items():
        if c in out:
            outside = (out[c] < s["lower"]) | (out[c] > s["upper"])
            out[c] = F.when(outside, F.lit(s["median"])).otherwise(out[c])
    return out


def add_calendar(df: DataFrame, date: str = "transaction_date") -> DataFrame:
    return df.withColumns(cal.calendar_features(date))


def scoring_features(
    df: DataFrame,
    prep: Preparation,
    numeric: Sequence[str],
    keep: Sequence[str] = (),
    date: str = "transaction_date",
) -> DataFrame:
    """Feature columns of new records, in training order, after ``in_<name>`` of ``keep``.

    Inputs that the model does not know are dropped, features that are absent (such as
    lags without history) are 0. Outlier limits are a training-time treatment and are
    not applied to requests.
    """
    # Context columns are copied before scaling and returned as `in_<name>`.
    context = {f"in_{c}": F.col(c) for c in keep}
    cleaned = apply_cleaning(add_calendar(df.withColumns(context), date), prep, numeric, outliers=False)
    return sel.align_columns(cleaned, prep.feature_columns, keep=list(context))
