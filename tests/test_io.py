"""Readers, validation, sinks, run log, monitoring and streams."""

import datetime as dt
import json

import pytest
from demandlens.operators import buckets
from demandlens.operators import features as fp
from demandlens.plans import monitoring, scoring, training
from demandlens.sources import readers, runlog, schemas, sinks
from demandlens.sources.star import AD_COLUMNS, ORDER_KEYS, sales, table
from demandlens.streaming import jobs
from pyspark.sql import functions as F

D = dt.date
FIELDS = ["Transaction_Date", "Category", "Region", "Units_Sold", "Discount_Applied", "Clicks", "Impressions"]
FIELDS += ["Conversion_Rate", "Ad_CTR", "Ad_CPC", "Ad_Spend"]
GOOD = ["2024-01-05", "Toys", "Asia", "3", "0.1", "10", "100", "0.1", "0.1", "0.5", "50"]


def test_transactions_csv_by_name(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("Revenue,Transaction_Date,Category,Extra\n10.5,2024-01-05,Toys,x\nNaN,2024-01-06,Books,y\n")
    df = readers.read_transactions_csv(spark, str(path))
    assert df.columns == ["revenue", "transaction_date", "category", "extra"]
    rows = df.orderBy("transaction_date").collect()
    assert rows[0]["revenue"] == 10.5 and rows[0]["transaction_date"] == D(2024, 1, 5)
    assert rows[1]["revenue"] is None


def bad_rows():
    units, date, region = list(GOOD), list(GOOD), list(GOOD)
    units[3], date[0], region[2] = "x", "bad", ""
    return [units, date, region]


def test_request_csv_validation(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("\n".join(",".join(r) for r in [FIELDS, GOOD, *bad_rows()]) + "\n")
    checked = readers.validate_requests(readers.read_requests_csv(spark, str(path)))
    assert readers.valid_rows(checked).select("units_sold", "transaction_date").collect()[0][:] == (3.0, D(2024, 1, 5))
    reasons = {r["reject_reason"] for r in readers.rejected_rows(checked).collect()}
    assert reasons == {"units_sold: not a number", "transaction_date: not a date", "region: missing"}


@pytest.mark.parametrize("wrapped", [False, True])
def test_request_json(spark, tmp_path, wrapped):
    rows = [dict(zip(FIELDS, r)) for r in [GOOD, *bad_rows()]]
    rows[0]["Units_Sold"] = 3  # numbers and text are both accepted
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"data": rows}) if wrapped else "\n".join(json.dumps(r) for r in rows))
    df = readers.read_requests_json(spark, str(path), wrapped)
    assert sorted(df.columns) == sorted(schemas.REQUEST_FIELDS)
    checked = readers.validate_requests(df)
    # An empty region is absent in CSV, but a value in JSON.
    assert readers.valid_rows(checked).count() == 2
    assert readers.rejected_rows(checked).count() == 2


def test_strict_dates_fail(spark):
    df = spark.createDataFrame([("bad",)], "d string").select(readers.parse_date("d").alias("d"))
    with pytest.raises(Exception, match="CANNOT_PARSE|INVALID"):
        df.collect()


def test_pushdown_and_pruning(spark, sf):
    """The date filter and the columns reach the scan; unneeded joins are not planned."""
    df = sales(spark, sf, []).filter(F.col("transaction_date").between(D(1997, 1, 1), D(1997, 2, 1)))
    plan = df.agg(F.sum("revenue"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    assert "ReadSchema: struct<l_extendedprice:double,l_discount:double,l_shipdate:timestamp_ntz>" in plan
    assert "Join" not in plan


def test_star_without_joins_equals_star_with_all(spark, sf):
    few, full = sales(spark, sf, []), sales(spark, sf, enforce=True)
    assert few.count() == full.count()


def test_processed_table_is_partitioned(spark, sf, tmp_path):
    path = str(tmp_path / "p")
    sinks.write_processed(sales(spark, sf, []), path)
    back = spark.read.parquet(path)
    assert back.count() == table(spark, sf, "lineitem").count()
    plan = back.filter("month_start = DATE '1997-01-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month_start" in plan


def test_series_and_export(spark, sf, tmp_path):
    daily = buckets.daily_series(sales(spark, sf, []))
    sinks.write_series(daily, str(tmp_path / "s"))
    sinks.export_csv(daily.limit(3), str(tmp_path / "e"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).columns == ["date", "Revenue"]
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).count() == 3


def test_baseline_round_trip_and_absence(spark, tmp_path):
    path = str(tmp_path / "b")
    assert sinks.read_baseline(spark, path).count() == 0
    sinks.write_baseline(spark.createDataFrame([(0.8, 5.0)], schemas.BASELINE), path)
    assert sinks.read_baseline(spark, path).collect()[0][:] == (0.8, 5.0)
    broken = tmp_path / "broken.json"
    broken.write_text("not json")
    assert sinks.read_baseline(spark, str(broken)).count() == 0


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "runs")
    metrics = spark.createDataFrame([("rf", "mae", 1.5)], "model string, metric string, value double")
    sinks.log_run(spark, path, "r1", {"trees": 100}, metrics)
    sinks.log_run(spark, path, "r2", {"trees": 50})
    sinks.log_run(spark, path, "r2", {"trees": 60})  # repeated run
    rows = {(r["run_id"], r["key"]): r["value"] for r in spark.read.parquet(path).collect()}
    assert rows == {("r1", "trees"): "100", ("r1", "rf_test_mae"): "1.5", ("r2", "trees"): "60"}


def scored_frame(spark, n=50, shift=0.0):
    rows = [(i, float(i % 7), float(i % 7) + shift + (i % 3) / 10) for i in range(n)]
    return spark.createDataFrame(rows, "k int, revenue double, predicted_revenue double")


def test_monitoring_tables(spark, tmp_path):
    path = str(tmp_path / "m")
    base = spark.createDataFrame([(0.9, 0.1)], schemas.BASELINE)
    for _ in range(2):  # the second time replaces the first
        monitoring.write_check(monitoring.check(scored_frame(spark, shift=3.0), base), path, "run-1", D(2024, 1, 1))
    reports = {r["metric"]: r["value"] for r in spark.read.parquet(f"{path}/reports").collect()}
    assert set(reports) == {"mae", "rmse", "r2", "mape"}
    alerts = [r["metric"] for r in spark.read.parquet(f"{path}/alerts").collect()]
    assert sorted(alerts) == ["mae", "r2"]
    assert spark.read.parquet(f"{path}/runs").filter("kind = 'metric'").count() == 4


def test_monitoring_without_actuals_is_silent(spark):
    scored = scored_frame(spark).withColumn("revenue", F.lit(None).cast("double"))
    base = spark.createDataFrame([(0.9, 0.1)], schemas.BASELINE)
    assert monitoring.check(scored, base).alerts.count() == 0


# --- streams ---------------------------------------------------------------------------


def test_complete_stream_equals_batch(spark, sf, tmp_path):
    stream = jobs.read_stream(spark, sf, table(spark, sf, "events").schema, pathGlobFilter="events.parquet")
    out = str(tmp_path / "daily")
    jobs.write_table(jobs.daily_totals(stream, "ts", "value"), out, str(tmp_path / "c")).awaitTermination()
    batch = table(spark, sf, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))
    both = spark.read.parquet(out).join(batch, "date").filter("n = transaction_count")
    assert both.count() == batch.count() == 30


def write_events(spark, path, rows):
    schema = "ts timestamp, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_late_rows_are_dropped(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    schema = "ts timestamp, value double"

    def run():
        totals = jobs.daily_totals(jobs.read_stream(spark, src, schema), "ts", "value", "1 day")
        jobs.append_table(totals, out, ckpt).awaitTermination()

    write_events(spark, src, [(at(1), 1.0), (at(1, 5), 2.0)])
    run()
    write_events(spark, src, [(at(5), 10.0)])
    run()
    write_events(spark, src, [(at(1, 6), 100.0), (at(9), 1.0)])  # the first is too late
    run()
    got = {r["date"]: r["revenue"] for r in spark.read.parquet(out).collect()}
    assert got[D(2024, 1, 1)] == 3.0
    assert got[D(2024, 1, 5)] == 10.0
    assert D(2024, 1, 9) not in got


def test_sliding_mean(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    write_events(spark, src, [(dt.datetime(2024, 1, d), 7.0) for d in range(1, 15)])
    means = jobs.sliding_daily_mean(jobs.read_stream(spark, src, "ts timestamp, value double"), "ts", "value")
    jobs.write_table(means, out, str(tmp_path / "c")).awaitTermination()
    got = {r["date"]: r["mean_revenue"] for r in spark.read.parquet(out).collect()}
    assert got[D(2024, 1, 7)] == got[D(2024, 1, 14)] == 7.0
    assert got[D(2024, 1, 1)] == 1.0


@pytest.fixture(scope="module")
def small_model(spark, sf):
    data = training.prepare(sales(spark, sf, ["category", "region", *AD_COLUMNS]), ORDER_KEYS)
    models = training.fit_models(data, {"trees": 3, "depth": 3}, {"rounds": 2, "depth": 2})
    yield data, models
    data.train.unpersist()


def raw_requests(spark, sf):
    df = sales(spark, sf, ["category", "region", *AD_COLUMNS])
    text = df.select(*[F.col(c).cast("string").alias(c) for c in schemas.REQUEST_FIELDS])
    return text.withColumn("units_sold", F.when(F.col("units_sold") == "7.0", "seven").otherwise(F.col("units_sold")))


def test_stream_scoring_equals_batch(spark, sf, tmp_path, small_model):
    data, models = small_model
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    raw = raw_requests(spark, sf)
    raw.repartition(3).write.parquet(src)
    numeric = schemas.NUMERIC_REQUEST_FIELDS
    for _ in range(2):  # a restart finds nothing new
        stream = jobs.read_stream(spark, src, schemas.RAW_REQUEST, maxFilesPerTrigger="1")
        jobs.score_stream(
            stream, models["random_forest"], data.preparation, numeric, out, str(tmp_path / "c")
        ).awaitTermination()
    checked = readers.validate_requests(raw)
    batch = scoring.predict(readers.valid_rows(checked), models["random_forest"], data.preparation, numeric)
    got = spark.read.parquet(f"{out}/scored")
    assert got.select("batch_id").distinct().count() == 3
    total = lambda df: df.agg(F.count("*"), F.round(F.sum("predicted_revenue"), 3)).first()[:]
    assert total(got) == total(batch)
    assert spark.read.parquet(f"{out}/rejected").count() == readers.rejected_rows(checked).count() > 0


def test_stream_monitoring(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    scored = scored_frame(spark, shift=3.0)
    scored.coalesce(1).write.mode("append").parquet(src)
    scored.coalesce(1).write.mode("append").parquet(src)
    base = spark.createDataFrame([(0.9, 0.1)], schemas.BASELINE)
    stream = jobs.read_stream(spark, src, scored.schema, maxFilesPerTrigger="1")
    jobs.monitor_stream(stream, base, out, str(tmp_path / "c"), D(2024, 1, 1)).awaitTermination()
    runs = spark.read.parquet(f"{out}/reports").groupBy("run_id").count().collect()
    assert {r["run_id"]: r["count"] for r in runs} == {"batch-0": 4, "batch-1": 4}


def test_scoring_keeps_inputs_and_rows(spark, sf, small_model):
    data, models = small_model
    df = sales(spark, sf, ["category", "region", *AD_COLUMNS]).select("l_orderkey", *schemas.REQUEST_FIELDS)
    out = scoring.predict(df, models["gradient_boosting"], data.preparation, training.NUMERIC, data.known_last)
    assert out.columns == [*df.columns, "predicted_revenue"]
    assert out.count() == df.count()
    assert out.filter("predicted_revenue < 0 or predicted_revenue is null").count() == 0
    # No shuffle beyond the joins that make the input.
    exchanges = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert exchanges(out) == exchanges(df)


def test_one_season_only_request(spark, small_model):
    data, models = small_model
    rows = [(D(2024, 1, 5), "ECONOMY", "ASIA", *[1.0] * 8)]
    df = spark.createDataFrame(rows, "transaction_date date, category string, region string, " + ", ".join(f"{c} double" for c in schemas.NUMERIC_REQUEST_FIELDS))
    prepared = fp.scoring_features(df, data.preparation, training.NUMERIC)
    row = prepared.first()
    assert (row["season_winter"], row["season_spring"], row["season_summer"]) == (1.0, 0.0, 0.0)


def test_saved_models_round_trip(spark, tmp_path, small_model):
    data, models = small_model
    path = str(tmp_path / "state")
    training.save_models(models, data.preparation, spark, path)
    loaded, prep = training.load_models(spark, path, list(models))
    assert prep == data.preparation
    a, b = (training.evaluate(m, data.test).collect() for m in (models, loaded))
    assert sorted(a) == sorted(b)
    with pytest.raises(FileNotFoundError, match="random_forest"):
        training.load_models(spark, str(tmp_path / "none"), ["random_forest"])


# --- log compaction and counts ---------------------------------------------------------


def _log(spark, path, runs):
    metrics = spark.createDataFrame([("mae", 1.0), ("r2", 0.5)], "metric string, value double")
    for run, day in runs:
        sinks.append_report(metrics, path, run, day)


def _seen(spark, path):
    return sorted((r["run_id"], r["n"]) for r in runlog.read_log(spark, path).groupBy("run_id").agg(F.count("*").alias("n")).collect())


def test_each_run_is_seen_once_through_compactions(spark, tmp_path):
    path = str(tmp_path / "reports")
    with pytest.raises(FileNotFoundError):
        runlog.read_log(spark, path)
    _log(spark, path, [("007", D(2024, 1, 1)), ("b", D(2024, 1, 2)), ("c", D(2024, 1, 3))])
    want = [("007", 2), ("b", 2), ("c", 2)]
    assert _seen(spark, path) == want
    assert runlog.compact(spark, path, D(2024, 1, 3)) == 1
    # The old folders are still there, for readers that began before.
    assert len(list((tmp_path / "reports").rglob("run_id=*"))) == 3 and _seen(spark, path) == want
    _log(spark, path, [("d", D(2024, 1, 4))])
    want.append(("d", 2))
    assert _seen(spark, path) == want
    assert runlog.compact(spark, path) == 2
    assert sorted(p.name for p in (tmp_path / "reports").rglob("run_id=*")) == ["run_id=c", "run_id=d"]
    assert _seen(spark, path) == want and runlog.versions(spark, path) == [1, 2]
    assert runlog.compact(spark, path) == 3
    assert not list((tmp_path / "reports").rglob("run_id=*")) and runlog.versions(spark, path) == [2, 3]
    assert _seen(spark, path) == want


def test_an_unfinished_compaction_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "reports")
    _log(spark, path, [("a", D(2024, 1, 1)), ("b", D(2024, 1, 2))])
    runlog.compact(spark, path)
    left = tmp_path / "reports_compacted" / "version=2"
    left.mkdir()
    (left / "part-0.parquet").write_text("half a file")
    assert _seen(spark, path) == [("a", 2), ("b", 2)]
    assert runlog.compact(spark, path) == 2
    assert _seen(spark, path) == [("a", 2), ("b", 2)]


def test_stream_counts_errors_while_it_writes(spark, sf, tmp_path, small_model):
    data, models = small_model
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    raw = raw_requests(spark, sf)
    raw.repartition(3).write.parquet(src)
    numeric = schemas.NUMERIC_REQUEST_FIELDS
    stream = jobs.read_stream(spark, src, schemas.RAW_REQUEST, maxFilesPerTrigger="1")
    jobs.score_stream_once(stream, models["random_forest"], data.preparation, numeric, out, str(tmp_path / "c")).awaitTermination()
    records, checked = spark.read.parquet(f"{out}/records"), readers.validate_requests(raw)
    rejected = {r["batch_id"]: r["count"] for r in records.filter("outcome = 'rejected'").groupBy("batch_id").count().collect()}
    counts = {r["batch_id"]: (r["num_rows"], r["num_errors"]) for r in spark.read.parquet(f"{out}/counts").collect()}
    assert {b: n for b, (_, n) in counts.items()} == rejected and len(counts) == 3
    assert sum(n for n, _ in counts.values()) == raw.count()
    assert sum(rejected.values()) == readers.rejected_rows(checked).count() > 0
    batch = scoring.predict(readers.valid_rows(checked), models["random_forest"], data.preparation, numeric)
    total = lambda df: df.agg(F.count("predicted_revenue"), F.round(F.sum("predicted_revenue"), 3)).first()[:]
    assert total(records) == total(batch)
    assert records.filter("outcome = 'rejected' AND (predicted_revenue IS NOT NULL OR reject_reason IS NULL)").count() == 0
