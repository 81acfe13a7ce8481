"""What a task reads, keeps or sends does not grow with the largest group or the number of partitions."""

from __future__ import annotations

import contextlib
import datetime as dt
from pathlib import Path

import pytest
from demandlens.catalog import stores
from demandlens.operators import align, bootstrap, trees
from demandlens.operators import features as fp
from demandlens.plans import training
from demandlens.session import SHUFFLE_CLEANUP, shared_folder, stage
from demandlens.sources.star import ORDER_KEYS
from pyspark.sql import functions as F


@contextlib.contextmanager
def settings(spark, **conf):
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_few_segments_do_not_shuffle_the_predictions(spark):
    history = spark.range(50_000).select(
        (F.col("id") % 3).cast("string").alias("category"), (F.col("id") % 2).cast("string").alias("region"), F.col("id").cast("double").alias("revenue")
    )
    more = spark.createDataFrame([("9", None, 1.0)], "category string, region string, predicted_revenue double")
    predictions = history.withColumnRenamed("revenue", "predicted_revenue").union(more)
    # Larger than the written averages, smaller than the history they come from.
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="20000"):
        out = align.compare_to_segments(predictions, history)
        rows = out.collect()
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert len(rows) == 50_001
    averages = {r["category"]: r["category_average"] for r in rows}
    assert averages["9"] is None and averages["0"] == pytest.approx(sum(range(0, 50_000, 3)) / len(range(0, 50_000, 3)))


def test_a_region_is_monitored_as_one_batch_of_many_files(spark, sf, monkeypatch):
    folders = {}
    monkeypatch.setattr(stores, "shared_folder", lambda s, name: folders.setdefault(name, shared_folder(s, name)))
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__coalescePartitions__enabled="false"):
        got = stores.st3(spark, sf).collect()
    assert len(list(Path(folders["batches"].removeprefix("file:")).glob("*.parquet"))) > 2 * len(stores.REGIONS)
    assert sorted({r["region"] for r in got}) == sorted(stores.REGIONS) and len(got) == 4 * len(stores.REGIONS)


def test_bootstrap_sends_sums_and_equals_the_plain_one(spark):
    rows = [(k, None if k % 5 == 0 else f"g{k % 3}", k % 2, float(k % 7) if k % 11 else None) for k in range(3_000)]
    df = spark.createDataFrame(rows, "k long, g string, h int, x double").withColumn("k", F.when(F.col("k") % 13 > 0, F.col("k")))
    by, keys = ["g", "h"], ["k"]
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="100"):
        out = bootstrap.mean_interval(df, by, "x", keys, replicates=20, seed=3)
        got = {r[:2]: r[2:] for r in out.collect()}
    # A list of replicates comes with a batch's group, not with a row.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and plan.index("Generate") < plan.index("MapInArrow")
    known = df.filter("x is not null")
    drawn = known.select(*by, "x", F.posexplode(bootstrap.weights([F.col("k")], 20, 3)).alias("r", "w"))
    value = drawn.groupBy(*by, "r").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("v"))
    ends = value.groupBy(*by).agg(F.percentile("v", F.lit(0.025)).alias("lower"), F.percentile("v", F.lit(0.975)).alias("upper"))
    plain = known.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
    want = {tuple(r[:2]): r[2:] for r in plain.join(ends, (plain.g.eqNullSafe(ends.g)) & (plain.h == ends.h)).select(plain.g, plain.h, "n", "mean", "lower", "upper").collect()}
    assert set(got) == set(want) and len(want) == 8
    for k, v in want.items():
        assert tuple(got[k]) == pytest.approx(tuple(v))


def _sales(spark):
    day = F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") / 10).cast("int"))
    numbers = {c: (F.col("id") * (i + 3) % 101).cast("double") for i, c in enumerate(training.NUMERIC)}
    names = F.array(F.lit("A B"), F.lit("C"), F.lit(None))
    text = {"category": F.get(names, (F.col("id") % 3).cast("int")), "region": F.get(names, (F.col("id") % 2).cast("int"))}
    return spark.range(4_000).withColumns({"transaction_date": day, **numbers, **text})


def test_what_training_keeps_and_sends(spark):
    with settings(spark, spark__sql__shuffle__partitions="200"):
        data = training.prepare(_sales(spark), ["transaction_date", "id"])
        assert data.train.count() + data.test.count() == 4_000 - 30
        # A partition sends statistics of all nodes of all trees, at each level.
        assert data.train.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    cached = [x for x in data.train._jdf.queryExecution().withCachedData().toString().split("\n") if "InMemoryRelation" in x]
    assert cached and not any("features#" in x for x in cached)
    columns = data.preparation.feature_columns
    assert columns[-1].startswith("season_") and columns.index("category_A B") < columns.index("region_C") < columns.index("revenue_lag_1")
    for r in data.train.limit(50).collect():
        assert [float(r[c]) for c in columns] == r["features"].toArray().tolist()
        assert r["category_A B"] + r["category_C"] == (0.0 if r["key_id"] % 3 == 2 else 1.0)
    for learner in (trees.random_forest(), trees.gradient_boosting()):
        assert not learner.getCacheNodeIds()


def test_training_shuffles_and_keeps_only_what_rows_cannot_be_expanded_from(spark):
    data = training.prepare(_sales(spark), ["transaction_date", "id"])
    kept = [x for x in data.train._jdf.queryExecution().withCachedData().toString().split("\n") if "InMemoryRelation" in x]
    assert kept and all("category#" in x and "revenue_lag_1#" in x for x in kept)
    assert not any(f"{c}#" in x for x in kept for c in ("category_A B", "region_C", "month", "is_weekend", "season_spring"))
    assert {"category_A B", "region_C", "month", "is_weekend"} <= set(data.train.columns)


@pytest.mark.parametrize("include_onehot", [False, True])
def test_rows_expanded_late_equal_those_cleaned_at_once(spark, include_onehot):
    df = _sales(spark)
    full, prep = training.feature_frame(df, ["transaction_date", "id"], include_onehot=include_onehot)
    names = [c for c in prep.feature_columns if "_lag_" not in c and "_rollmean_" not in c]
    at_once = fp.add_calendar(fp.apply_cleaning(df, prep, training.NUMERIC))
    assert names == [c for c in at_once.columns if c not in ("id", "transaction_date", "revenue")]
    want = {r["id"]: [r[c] for c in [*names, "revenue"]] for r in at_once.collect()}
    got = {r["key_id"]: [r[c] for c in [*names, "revenue"]] for r in full.collect()}
    assert len(got) == 4_000 - 30 and all(want[k] == v for k, v in got.items())
    # A row without category or region is kept: its flags are 0, or the median where flags are treated.
    assert any(k % 3 == 2 for k in got) and any(k % 2 == 0 for k in got)


def test_staged_tables_leave_no_shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in Path(d).glob("*/shuffle_*")}
    before, setting = files(), spark.conf.get(SHUFFLE_CLEANUP)
    groups = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("s"))
    staged = stage(groups.repartition(3))
    assert not files() - before
    assert spark.conf.get(SHUFFLE_CLEANUP) == setting
    assert sorted(staged.collect()) == sorted(groups.collect()) and staged.count() == 100


def test_requests_are_removed_after_the_stream(spark, sf, monkeypatch):
    made = []
    monkeypatch.setattr(stores, "stage", lambda *a: made.append(stage(*a)) or made[-1])
    data = training.prepare(stores.sales(spark, sf, ["category", "region", *stores.AD_COLUMNS]), ORDER_KEYS)
    model = trees.random_forest(trees=2, depth=2).fit(data.train)
    monkeypatch.setattr("demandlens.catalog.modelling.fitted", lambda *_: (data, {"random_forest": model}))
    rows = stores.st1(spark, sf).collect()
    assert len(made) == 1 and not Path(made[0]._staged_at.removeprefix("file:")).exists()
    assert sum(r["n"] for r in rows) == stores.sales(spark, sf, []).count()
