"""CSV folders of several headers, lags with history, stored forecasts, drift, imputation, intervals, stored layouts."""

import datetime as dt
import gzip
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from demandlens.operators import bootstrap, buckets, drift, forecast, forecast_store, history, impute
from demandlens.operators import features as fp
from demandlens.plans import scoring, training
from demandlens.session import stage
from demandlens.sources import bucketed, csv_files, readers
from demandlens.sources.star import AD_COLUMNS, ORDER_KEYS, sales
from demandlens.streaming import jobs
from pyspark.sql import functions as F

D = dt.date


# --- CSV -------------------------------------------------------------------------------


def test_columns_follow_each_files_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Transaction_Date,Category,Region,Revenue,Clicks\n2024-01-05,Books,Asia,10.5,3\n")
    (tmp_path / "b.csv").write_text("Transaction_Date,Region,Category,Clicks,Revenue\n2024-01-06,Asia,Books,3,10.5\n")
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write("Clicks,Extra,Transaction_Date,Region\n4,x,2024-01-07,Europe\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "_hidden.csv").write_text("Nothing\n1\n")
    df = readers.read_transactions_csv(spark, str(tmp_path))
    rows = {r["transaction_date"]: r.asDict() for r in df.collect()}
    for day in (D(2024, 1, 5), D(2024, 1, 6)):
        assert rows[day] == {"transaction_date": day, "category": "Books", "region": "Asia", "revenue": 10.5, "clicks": 3.0, "extra": None}
    assert rows[D(2024, 1, 7)] == {"transaction_date": D(2024, 1, 7), "category": None, "region": "Europe", "revenue": None, "clicks": 4.0, "extra": "x"}


def test_csv_equals_union_by_name(spark, tmp_path):
    rnd = random.Random(3)
    names = ["Transaction_ID", "Transaction_Date", "Category", "Region", "Units_Sold", "Revenue", "Clicks"]
    for number in range(6):
        header = rnd.sample(names, rnd.randint(4, 7))
        lines = [",".join(header)]
        for i in range(40):
            value = {
                "Transaction_ID": f"t{number}-{i}", "Transaction_Date": f"2024-0{rnd.randint(1, 9)}-1{rnd.randint(0, 9)}", "Region": rnd.choice(["Asia", "", '"x, ""y"""']),
                "Category": rnd.choice(["Toys", "Books"]), "Units_Sold": rnd.choice(["3", "", "2.5"]), "Revenue": str(rnd.random()), "Clicks": "7",
            }
            lines.append(",".join(value[c] for c in header))
        (tmp_path / f"{number}.csv").write_text("\n".join(lines) + "\n")
    got = readers.read_transactions_csv(spark, str(tmp_path))
    columns = [c.lower() for c in names]
    want = duckdb.sql(f"SELECT {', '.join(names)} FROM read_csv('{tmp_path}/*.csv', union_by_name = true, header = true, all_varchar = true)").fetchall()
    clean = lambda v: None if v in (None, "") else v
    number = lambda v: None if clean(v) is None else float(v)
    typed = [(clean(r[0]), r[1] and D.fromisoformat(r[1]), clean(r[2]), clean(r[3]), *map(number, r[4:])) for r in want]
    key = lambda r: tuple(map(repr, r))
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=key) == sorted(typed, key=key)


def test_malformed_lines_are_rejected_with_a_reason(spark, tmp_path):
    text = "Transaction_Date,Category,Revenue\n2024-01-05,Toys,1\n2024-01-06,Toys\n2024-01-07,Toys,1,2\nbad,Toys,1\n2024-01-08,Toys,x\n,,\n2024-01-09,Toys,NaN\n"
    (tmp_path / "a.csv").write_text(text)
    checked = readers.check_transactions_csv(spark, str(tmp_path))
    bad = {(r["line"], r["reject_reason"]) for r in csv_files.rejected(checked).collect()}
    assert bad == {
        ("2024-01-06,Toys", "line does not have 3 fields"),
        ("2024-01-07,Toys,1,2", "line does not have 3 fields"),
        ("transaction_date=bad", "transaction_date: not a date"),
        ("revenue=x", "revenue: not a number"),
    }
    good = readers.read_transactions_csv(spark, str(tmp_path))
    assert sorted(good.select("revenue").collect(), key=repr) == [(1.0,), (None,), (None,)]
    # The count does not depend on which columns are read.
    assert good.select("category").count() == good.count() == 3
    assert all(r["source_file"].endswith("a.csv") for r in csv_files.rejected(checked).collect())


def test_a_header_that_names_a_column_twice_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Revenue,revenue\n1,2\n")
    with pytest.raises(ValueError, match="twice"):
        readers.read_transactions_csv(spark, str(tmp_path))


def test_a_folder_without_files_is_an_empty_table(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert readers.read_requests_csv(spark, str(tmp_path)).collect() == []


# --- lags with history -----------------------------------------------------------------


def _series(seed, n, unknown=False):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = rnd.choice(["a", "a", "a", "b", "c"])
        rows.append((key, D(2024, 1, 1) + dt.timedelta(days=rnd.randint(0, 40)), i, None if unknown and rnd.random() < 0.1 else rnd.random(), float(rnd.randint(1, 9))))
    return sorted(rows, key=lambda r: r[1:3])


SCHEMA = "k string, d date, i long, revenue double, units_sold double"


def _plain(old, new, by):
    """Lags of pandas over both, for the new rows."""
    both = pd.DataFrame([*old, *new], columns=["k", "d", "i", "revenue", "units_sold"]).sort_values(["d", "i"])
    groups = both.groupby("k") if by else [(None, both)]
    out = {}
    for _, g in groups:
        for m, c in (("revenue", "revenue"), ("units", "units_sold")):
            g = g.assign(**{f"{m}_lag_{k}": g[c].shift(k) for k in (1, 3)})
            g = g.assign(**{f"{m}_rollmean_4": g[c].rolling(4).mean()})
        for r in g.to_dict("records"):
            out[r["i"]] = {c: None if pd.isna(r[c]) else round(r[c], 9) for c in history.feature_names((1, 3), (4,))}
    return {r[2]: out[r[2]] for r in new}


@pytest.mark.parametrize("by", [(), ("k",)])
@pytest.mark.parametrize("cut", [0, 150, 199])
def test_lags_over_history_and_new_rows(spark, by, cut):
    rows = _series(1, 200, unknown=True)
    old, new = rows[:cut], rows[cut:]
    # Two old rows lie between the new ones.
    old, new = [*old, *new[5:7]], [*new[:5], *new[7:]]
    tables = [spark.createDataFrame(t, SCHEMA) for t in (old, new)]
    got = history.with_history(*tables, ["d", "i"], by, (1, 3), (4,), block_rows=16)
    names = history.feature_names((1, 3), (4,))
    found = {r["i"]: {c: None if r[c] is None else round(r[c], 9) for c in names} for r in got.collect()}
    assert found == _plain(old, new, by)
    assert got.columns == [*tables[1].columns, *names]


def test_new_rows_without_the_measure_look_back_on_known_rows_only(spark):
    old = spark.createDataFrame([("a", D(2024, 1, 1), i, float(i), 1.0) for i in range(5)], SCHEMA)
    new = spark.createDataFrame([("a", D(2024, 1, 2), 9, 2.0), ("a", D(2024, 1, 3), 10, 3.0)], "k string, d date, i long, units_sold double")
    rows = history.with_history(old, new, ["d", "i"], ["k"], (1, 3), (4,)).orderBy("i").collect()
    assert [(r["revenue_lag_1"], r["revenue_lag_3"], r["units_lag_1"]) for r in rows] == [(4.0, 2.0, 1.0), (None, 3.0, 2.0)]


def test_history_is_cut_down_before_the_shuffle(spark):
    old = spark.createDataFrame(_series(1, 50), SCHEMA)
    plan = history.series_tail(old, ["d", "i"], 30, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = _series(5, 240, unknown=True)
    old, parts = rows[:80], [rows[80:130], rows[130:131], rows[131:]]
    new = [r for p in parts for r in p]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame(new, SCHEMA).schema, maxFilesPerTrigger="1")
    for start, before in ((old, old), (None, [])):
        out = str(tmp_path / f"out{len(before)}")
        history_table = spark.createDataFrame(start, SCHEMA) if start else None
        lagged = history.stream_with_history(history_table, stream, ["d", "i"], ["k"], (1, 3), (4,))
        query = jobs.append_table(lagged, out, str(tmp_path / f"state{len(before)}"))
        query.awaitTermination()
        assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
        names = history.feature_names((1, 3), (4,))
        got = {r["i"]: {c: None if r[c] is None else round(r[c], 9) for c in names} for r in spark.read.parquet(out).collect()}
        assert got == _plain(before, new, ("k",))


def test_scores_use_the_lags_of_training(spark, sf):
    """Rows scored with their history get the features they had in the training table."""
    columns = ["category", "region", *AD_COLUMNS]
    df = stage(sales(spark, sf, columns).select(*ORDER_KEYS, "units_sold", "discount_applied", "revenue", *columns))
    full, prep = training.feature_frame(df, ORDER_KEYS)
    old, new = buckets.time_split(df)
    lagged = scoring.with_lags(old, new, prep, training.NUMERIC, ORDER_KEYS)
    names = history.feature_names()
    keys = ORDER_KEYS
    rounded = lambda t, k: t.select(*[F.col(c).alias(n) for n, c in zip(keys, k)], *[F.round(c, 6).alias(c) for c in names])
    want = rounded(full, [f"key_{c}" for c in keys])
    got = rounded(lagged, keys)
    assert got.count() == new.count() > 0
    assert got.join(want, [*keys, *names]).count() == got.count()


# --- stored forecasts ------------------------------------------------------------------


def _daily(spark, days=200, seed=1, keys=("a", "b", "short", "flat")):
    rnd = np.random.default_rng(seed)
    rows = []
    for k in keys:
        n = 30 if k == "short" else days
        values = 100 + 10 * np.sin(np.arange(n) * 2 * np.pi / 7) + np.cumsum(rnd.normal(size=n)) if k != "flat" else np.full(n, 5.0)
        rows += [(k, D(2024, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, date date, revenue double")


def test_forecast_from_the_store_equals_a_fresh_fit(spark, tmp_path):
    daily = _daily(spark)
    forecast_store.save_store(forecast_store.fit_store(daily, ["k"]), str(tmp_path / "store"))
    store = spark.read.parquet(str(tmp_path / "store"))
    for first, last in ((190, 199), (150, 230), (205, 260), (300, 300)):
        span = [D(2024, 1, 1) + dt.timedelta(days=d) for d in (first, last)]
        want = {(r["k"], r["date"]): r for r in forecast.forecast_range(daily, *span, by=["k"]).collect()}
        got = {(r["k"], r["date"]): r for r in forecast_store.forecast_from_store(store, *span, by=["k"]).collect()}
        assert got.keys() == want.keys() and got
        for k, r in got.items():
            assert r["method"] == want[k]["method"]
            for c in ("predicted_revenue", "lower", "upper"):
                assert r[c] == pytest.approx(want[k][c], abs=1e-6)
    assert {r["method"] for r in store.collect()} == {"sarima", "seasonal_naive"}


def test_forecasting_runs_without_python_or_shuffle(spark, tmp_path):
    forecast_store.save_store(forecast_store.fit_store(_daily(spark), ["k"]), str(tmp_path / "store"))
    out = forecast_store.forecast_from_store(spark.read.parquet(str(tmp_path / "store")), D(2024, 8, 1), D(2024, 9, 1), ["k"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan


def test_a_store_moves_with_new_days(spark):
    """Moved over later days, a store has the tail and the one-step predictions of its terms over all days."""
    daily = _daily(spark, 120, keys=("a", "flat"))
    cut = D(2024, 1, 1) + dt.timedelta(days=99)
    terms = ((0.2, 0.1, -0.02), (-0.5, -0.6, 0.3), 2.0, ["k"])
    whole = forecast_store.store_with_terms(daily, *terms)
    part = stage(forecast_store.store_with_terms(daily.filter(F.col("date") <= F.lit(cut)), *terms), "part")
    key = lambda r: [r["k"], r["last_date"], len(r["past"]), *[round(x, 6) for c in ("y", "w", "e") for x in r[c]]]
    moved = forecast_store.advance(part, daily, ["k"])
    assert sorted(map(key, moved.collect())) == sorted(map(key, whole.collect()))
    # Days that the store knows change nothing.
    again = forecast_store.advance(part, daily.filter(F.col("date") <= F.lit(cut)), ["k"])
    assert sorted(map(key, again.collect())) == sorted(map(key, part.collect()))


def test_naive_series_move_and_one_series_needs_no_key(spark):
    daily = _daily(spark, 30, keys=("short",))
    early = daily.filter(F.col("date") <= F.lit(D(2024, 1, 20)))
    store = stage(forecast_store.fit_store(early.drop("k")), "one")
    moved = forecast_store.advance(store, daily.drop("k"))
    span = (D(2024, 1, 31), D(2024, 2, 10))
    tail = [r["revenue"] for r in daily.orderBy("date").collect()][-7:]
    got = [r["predicted_revenue"] for r in forecast_store.forecast_from_store(moved, *span).orderBy("date").collect()]
    assert got == pytest.approx([tail[i % 7] for i in range(11)])
    with pytest.raises(ValueError, match="after"):
        forecast_store.forecast_from_store(store, span[1], span[0])


# --- drift -----------------------------------------------------------------------------


def test_ks_distance_of_plain_samples(spark):
    rnd = random.Random(8)
    base = [(rnd.gauss(0, 1), float(rnd.randint(0, 3)), None) for _ in range(300)] + [(None, math.nan, None)]
    now = [(rnd.gauss(0.4, 1), float(rnd.randint(0, 3)), 1.0) for _ in range(200)]
    tables = [spark.createDataFrame(t, "x double, y double, z double") for t in (base, now)]
    got = {r["column"]: r for r in drift.ks_distances(*tables, ["x", "y", "z"]).collect()}
    assert set(got) == {"x", "y"}
    for i, c in enumerate("xy"):
        a, b = ([r[i] for r in t if r[i] is not None and not math.isnan(r[i])] for t in (base, now))
        want = max(abs(sum(v <= x for v in a) / len(a) - sum(v <= x for v in b) / len(b)) for x in [*a, *b])
        assert got[c]["distance"] == pytest.approx(want) and got[c]["base_rows"] == len(a)
        scaled = math.sqrt(len(a) * len(b) / (len(a) + len(b))) * want
        p = 1.0 if scaled < 0.2 else min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * scaled**2) for k in range(1, 101)))
        assert got[c]["p_value"] == pytest.approx(p)
    assert got["x"]["p_value"] < 0.001 < 0.2 < got["y"]["p_value"]


def test_ks_of_equal_and_of_apart_samples(spark):
    a = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    same = drift.ks_distances(a, a, ["x"]).first()
    assert (same["distance"], same["p_value"]) == (0.0, 1.0)
    apart = drift.ks_distances(a, a.select((F.col("x") + 1000).alias("x")), ["x"]).first()
    assert apart["distance"] == 1.0 and apart["p_value"] < 1e-9
    assert drift.ks_distances(a, a.limit(0), ["x"]).collect() == []


def test_stability_index_of_a_moved_population(spark, tmp_path):
    rnd = random.Random(2)
    row = lambda shift, kinds: (rnd.gauss(shift, 1), rnd.choice(kinds))
    base = spark.createDataFrame([row(0, "aab") for _ in range(3000)], "x double, k string")
    near = spark.createDataFrame([row(0, "aab") for _ in range(3000)], "x double, k string")
    far = spark.createDataFrame([row(1, "abc") for _ in range(3000)] + [(None, None)] * 10, "x double, k string")
    edges = drift.fit_edges(base, ["x"])
    assert len(edges["x"]) == 9 and edges["x"] == sorted(edges["x"])
    level = lambda t: {r["column"]: r["level"] for r in drift.stability_index(drift.stability_cells(base, t, edges, ["k"])).collect()}
    assert level(near) == {"x": "stable", "k": "stable"}
    assert level(far) == {"x": "shifted", "k": "shifted"}
    cells = drift.stability_cells(base, far, edges, ["k"]).collect()
    assert {(r["column"], r["cell"]) for r in cells} >= {("x", drift.MISSING), ("k", "c"), ("k", drift.MISSING), ("x", "0"), ("x", "9")}
    assert all(r["part"] >= 0 for r in cells)
    for c in ("x", "k"):
        assert sum(r["base_share"] for r in cells if r["column"] == c) == pytest.approx(1.0)


# --- imputation ------------------------------------------------------------------------


def test_missing_values_fall_back_to_wider_groups(spark):
    rows = [("A", "e", 1.0), ("A", "e", 3.0), ("A", "e", None), ("A", "w", None), ("B", "w", None), ("C", "w", 8.0), ("C", "w", math.nan), (None, "e", None), ("A", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, category string, region string, x double")
    state = impute.fit_imputer(df, ["x"])
    got = {r["i"]: (r["x"], r["x_missing"]) for r in impute.apply_imputer(df, state, ["x"]).collect()}
    assert got == {0: (1.0, 0.0), 1: (3.0, 0.0), 2: (2.0, 1.0), 3: (2.0, 1.0), 4: (4.0, 1.0), 5: (8.0, 0.0), 6: (8.0, 1.0), 7: (4.0, 1.0), 8: (2.0, 1.0)}
    # Unknown groups take the mean of all; a column without any value stays empty.
    new = spark.createDataFrame([(0, "Z", "z", None)], "i int, category string, region string, x double")
    assert impute.apply_imputer(new, state, ["x"]).first()["x"] == 4.0
    none = df.withColumn("x", F.lit(None).cast("double"))
    assert impute.apply_imputer(none, impute.fit_imputer(none, ["x"]), ["x"]).filter("x IS NOT NULL").count() == 0


def test_preparation_keeps_edges_and_imputation(spark, sf, tmp_path):
    df = stage(sales(spark, sf, ["category", "region", *AD_COLUMNS]).withColumn("units_sold", F.when(F.col("l_orderkey") % 5 != 0, F.col("units_sold"))))
    prep = fp.fit_preparation(df, training.NUMERIC, imputed=["units_sold"], bins=5)
    prep.save(spark, str(tmp_path / "state"))
    loaded = fp.Preparation.load(spark, str(tmp_path / "state"))
    assert loaded.edges == prep.edges and 1 <= len(loaded.edges["revenue"]) <= 4 and loaded.imputed == ["units_sold"]
    for state in (prep, loaded):
        out = fp.apply_cleaning(df, state, training.NUMERIC)
        assert out.filter("units_sold IS NULL").count() == 0
        assert out.agg(F.sum("units_sold_missing")).first()[0] == df.filter("units_sold IS NULL").count() > 0
    key = ["l_orderkey", "l_linenumber", "l_partkey", "units_sold"]
    once, twice = (fp.apply_cleaning(df, s, training.NUMERIC).select(key) for s in (prep, loaded))
    assert once.exceptAll(twice).count() == 0


# --- intervals -------------------------------------------------------------------------


def test_bootstrap_weights_are_poisson_and_repeatable(spark):
    df = spark.range(4000).select("id", (F.col("id") % 100).cast("double").alias("x"), F.lit("g").alias("g"))
    drawn = df.select(F.explode(bootstrap.weights([F.col("id")], 48)).alias("w"))
    counts = {r["w"]: r["count"] / 192_000 for r in drawn.groupBy("w").count().collect()}
    for k in range(4):
        assert counts[k] == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.005)
    first = bootstrap.mean_interval(df, ["g"], "x", ["id"]).collect()
    assert first == bootstrap.mean_interval(df.repartition(7), ["g"], "x", ["id"]).collect()
    r = first[0]
    error = 28.87 / math.sqrt(4000)
    assert r["n"] == 4000 and r["mean"] == 49.5
    assert r["mean"] - r["lower"] == pytest.approx(1.96 * error, rel=0.4) and r["upper"] - r["mean"] == pytest.approx(1.96 * error, rel=0.4)
    other = bootstrap.mean_interval(df, ["g"], "x", ["id"], seed=1).first()
    assert (other["lower"], other["upper"]) != (r["lower"], r["upper"])
    assert bootstrap.mean_interval(df.withColumn("x", F.lit(None).cast("double")), ["g"], "x", ["id"]).collect() == []


# --- stored layouts --------------------------------------------------------------------


def test_bucketed_join_has_no_shuffle(spark, sf, tmp_path):
    facts, orders = bucketed.write_star(spark, sf, str(tmp_path / "star"), f"t_{tmp_path.name}".replace("-", "_"), 4)
    plan = bucketed.star_join(facts, orders)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
    want = sales(spark, sf, ["category", "region", "customer_id"]).select(*ORDER_KEYS, "customer_id", "category", "region")
    got = bucketed.star_join(facts, orders).select(want.columns)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
