"""Station-series operators against small goldens and pandas restatements."""

from __future__ import annotations

import json
import math
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skylattice import config
from skylattice.functions import timefns
from skylattice.operators import encode, gapfill, lags, merge, metrics, models, resample, scaling, spatial, windows
from skylattice.plans import bundle, experiments, inference, training
from skylattice.schema import require
from skylattice.sources import metadata, netcdf, observations, tables, webservice

START = datetime(2024, 1, 1)


def hours(n: int, station: str = "S", f=lambda i: float(i)) -> list[tuple]:
    return [(station, START + timedelta(hours=i), f(i)) for i in range(n)]


def test_local_text_becomes_utc(spark):
    df = spark.createDataFrame([("A", "2024-01-01 00:00:00"), ("A", "2024-01-01T00:00:00+00:00"), ("A", "no time")], "station_id string, datetime string")
    got = [r.datetime for r in timefns.align(df, "Asia/Seoul").collect()]
    assert got == [datetime(2023, 12, 31, 15), datetime(2024, 1, 1), None]
    assert timefns.is_hourly(spark.createDataFrame(hours(5), "station_id string, datetime timestamp, v double")).first().hourly


def test_bilinear_and_its_fallbacks(spark):
    rows = [(START, 0.0, 0.0, 10.0), (START, 0.0, 1.0, 12.0), (START, 1.0, 0.0, 14.0), (START, 1.0, 1.0, 16.0)]
    grid = spark.createDataFrame(rows, "datetime timestamp, lat double, lon double, era5_t2m double")
    at = spark.createDataFrame([("mid", 0.5, 0.5), ("out", 5.0, 5.0), ("edge", 0.0, 0.4), ("part", 0.25, 0.75)], "station_id string, lat double, lon double")
    got = {r.station_id: r.era5_t2m for r in spatial.at_stations(grid, at, "bilinear").collect()}
    assert got == {"mid": 13.0, "out": 16.0, "edge": 10.0, "part": 10 * 0.75 * 0.25 + 14 * 0.25 * 0.25 + 12 * 0.75 * 0.75 + 16 * 0.25 * 0.75}
    hole = grid.withColumn("era5_t2m", F.when(F.col("era5_t2m") < 16, F.col("era5_t2m")))
    assert spatial.at_stations(hole, at.where("station_id = 'mid'"), "bilinear").first().era5_t2m is None  # there, but null
    gone = grid.where("era5_t2m < 16")
    assert spatial.at_stations(gone, at.where("station_id = 'mid'"), "bilinear").first().era5_t2m == 10.0  # missing: nearest


@pytest.mark.parametrize("limit", [0, 100])
def test_grids_whose_points_change_are_brute_force(spark, monkeypatch, limit):
    """Points differ by time, one repeats, one has no place; stations tie, lie outside, and have no place."""
    monkeypatch.setattr(spatial, "STATIONS", limit)
    later = datetime(2024, 1, 1, 7)
    rows = [(START, float(a), float(b), float(10 * a + b)) for a in range(3) for b in range(3)] + [(later, a * 0.75, b * 1.5, a - b * 2.0) for a in range(4) for b in range(3) if (a, b) != (1, 1)]
    rows += [(START, 1.0, 1.0, 99.0), (START, None, 1.0, -5.0)]
    at = [("tie", 0.5, 0.5), ("in", 1.2, 1.9), ("out", -3.0, 9.0), ("hole", 0.8, 1.6), ("nowhere", None, 1.0)]
    grid = spark.createDataFrame(rows, "datetime timestamp, lat double, lon double, v double")
    got = {(r.station_id, r.datetime): r.v for r in spatial.at_stations(grid, spark.createDataFrame(at, "station_id string, lat double, lon double")).collect()}
    want = {}
    for name, y, x in at[:4]:
        for t in (START, later):
            want[name, t] = min(((a - y) ** 2 + (b - x) ** 2, a, b, v) for u, a, b, v in rows if u == t and a is not None)[3]
    assert got == want
    empty = spatial.at_stations(grid.limit(0), spark.createDataFrame(at, "station_id string, lat double, lon double"), "bilinear")
    assert empty.columns == ["station_id", "datetime", "v"] and empty.count() == 0


def test_two_feeds_merge_by_priority(spark):
    schema = "station_id string, datetime timestamp, temp double, humidity double, pressure double, wind_speed double, precipitation double, quality_flag string"
    asos = spark.createDataFrame([("S", START, 10.0, None, 1000.0, 1.0, 0.0, None)], schema)
    flags = [70.0, 74.0, 80.0]
    aws = spark.createDataFrame([("S", START + timedelta(minutes=20 * i), 999.0, flags[i % 3], 1008.0, [1.0, 3.0, 5.0][i % 3], 0.1, "aws") for i in range(6)], schema)
    a = observations.standardise(asos, source_tz="UTC", source_name="asos")
    b = observations.standardise(aws, source_tz="UTC", resample_rule="1h", source_name="aws")
    got = {r.datetime: r for r in observations.merge_sources([(0, a), (1, b)]).collect()}
    first, second = got[START], got[START + timedelta(hours=1)]
    assert (first.temp, round(first.humidity, 4), first.observation_sources, first.quality_flag) == (10.0, 74.6667, "asos,aws", "")
    assert (second.temp, second.wind_speed, round(second.precipitation, 6), second.observation_source) == (999.0, 3.0, 0.3, "aws")
    with pytest.raises(ValueError):
        observations.merge_sources([(0, a)], "latest")


def test_resample_rules():
    assert resample.seconds_of("1h") == 3600 and resample.seconds_of("30min") == 1800 and resample.seconds_of("D") == 86400
    for bad in ("7h", "x", "0h"):
        with pytest.raises(ValueError):
            resample.seconds_of(bad)


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_gap_fill_is_pandas(spark, limit):
    rng = np.random.default_rng(limit)
    rows, want = [], {}
    for s in range(12):
        v = np.where(rng.random(30) < 0.6, np.nan, rng.normal(size=30))
        rows += [(str(s), START + timedelta(hours=i), None if math.isnan(x) else float(x)) for i, x in enumerate(v)]
        want[str(s)] = pd.Series(v).interpolate(limit=limit, limit_direction="both").ffill().bfill().to_numpy()
    df = spark.createDataFrame(rows, "station_id string, datetime timestamp, obs_temp double")
    got = gapfill.fill_gaps(df, ["obs_temp"], limit).orderBy("station_id", "datetime").toPandas()
    for s, part in got.groupby("station_id"):
        np.testing.assert_allclose(part.obs_temp.to_numpy(), want[s], rtol=1e-12)


def test_lags_and_rolls_are_pandas(spark):
    rng = np.random.default_rng(3)
    v = np.where(rng.random(60) < 0.1, np.nan, rng.normal(size=60))
    df = spark.createDataFrame([("S", START + timedelta(hours=i), None if math.isnan(x) else float(x)) for i, x in enumerate(v)], "station_id string, datetime timestamp, target_value double")
    got = lags.lag_features(df, {"target_value": [1, 24]}, {"target_value": [3]}, {"target_value": [2]}).orderBy("datetime").toPandas()
    s = pd.Series(v)
    for name, want in {"lag_1": s.shift(1), "lag_24": s.shift(24), "roll_mean_3": s.shift(1).rolling(3).mean(), "roll_std_3": s.shift(1).rolling(3).std(ddof=0), "delta_2": s - s.shift(2), "same_hour_prev_day": s.shift(24)}.items():
        np.testing.assert_allclose(got[f"target_value_{name}"].to_numpy(float), want.to_numpy(), atol=1e-9)


def test_window_counts_and_contiguity(spark):
    rows = [(s, t, v, "train" if t < START + timedelta(hours=48) else "val") for s, t, v in hours(72)]
    df = spark.createDataFrame(rows, "station_id string, datetime timestamp, v double, split string")
    v1 = windows.sliding(df, ["v"], [], [], ["v"], 6, 3, contiguous=False)
    assert {r.split: r["count"] for r in v1.groupBy("split").count().collect()} == {"train": 48 - 8, "val": 24 - 8}
    v2 = windows.sliding(df, ["v"], [], [], ["v"], 6, 3)
    assert {r.split: r["count"] for r in v2.groupBy("split").count().collect()} == {"train": 40, "val": 24 - 2}
    holed = df.where(F.col("v") != 30)
    assert windows.sliding(holed, ["v"], [], [], ["v"], 6, 3).count() == 62 - 9
    one = windows.persistence(v2, [0], 4).orderBy("prediction_start").first()
    assert [x[0] for x in one.predicted] == [2.0] * 3 and [x[0] for x in one.target] == [6.0, 7.0, 8.0]


def test_ridge_is_the_closed_form(spark, monkeypatch):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(s, START + timedelta(hours=i), float(rng.normal()), "train") for s in "AB" for i in range(40)], "station_id string, datetime timestamp, v double, split string")
    w = windows.sliding(df, ["v"], [], [], ["v"], 4, 2)
    model = models.make("ridge", w, ["v"], ["v"], alpha=3.0)
    p = w.toPandas()
    x = np.column_stack([np.array([[e[0] for e in r] for r in p.encoder]), np.ones(len(p))])
    y = np.array([[t[0] for t in r] for r in p.target])
    pull = 3.0 * np.eye(5)
    pull[-1, -1] = 0
    want = np.linalg.solve(x.T @ x + pull, x.T @ y)
    np.testing.assert_allclose(np.vstack([model.weights, model.bias]), want, atol=1e-9)
    again = models.Ridge.loaded(model.dumped())
    got = np.array([[s[0] for s in r.predicted] for r in again.predict(w).collect()])
    assert got.shape == (len(p), 2)
    assert len(model.importance(windows.flattened_names(["v"], [], [], 4, 2), ["v"])) == 8
    with pytest.raises(ValueError):
        models.make("oracle", w, ["v"], ["v"])
    monkeypatch.setattr(models, "TILE", 5)  # sums of several partitions in many tiles
    np.testing.assert_allclose(models.fit_ridge(w.repartition(3), 3.0).weights, model.weights, atol=1e-9)
    with pytest.raises(ValueError, match="no training windows"):
        models.fit_ridge(w.limit(0))


def test_metrics_ignore_null_pairs_unless_strict(spark):
    df = spark.createDataFrame([("t", 1.0, 2.0), ("t", 3.0, 0.0), ("t", None, 1.0)], "target_name string, prediction double, actual double")
    r = metrics.metrics(df).first()
    assert (round(r.rmse, 9), r.mae, r.bias, r.mape, r["count"]) == (round(math.sqrt(5), 9), 2.0, 1.0, 50.0, 3)
    assert math.isnan(metrics.metrics(df, strict=True).first().rmse)


def test_postprocess_modes(spark):
    df = spark.createDataFrame([("A", 1, 5.0, 4.0), ("A", 2, 9.0, 5.0), ("B", 1, 120.0, 100.0)], "station_id string, horizon_step int, prediction double, actual double")
    for mode, want in {"global": [5 - 25 / 3, 9 - 25 / 3, 120 - 25 / 3], "per_horizon": [-5.5, 5.0, 109.5], "per_station_horizon": [4.0, 5.0, 100.0]}.items():
        got = [r.prediction for r in metrics.postprocess(df, metrics.fit_bias(df, mode), mode, 0, 100).orderBy("station_id", "horizon_step").collect()]
        assert got == pytest.approx([min(max(x, 0), 100) for x in want])
    assert [r.prediction for r in metrics.postprocess(df, None).collect()] == [5.0, 9.0, 120.0]


def test_scaler_modes(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 3.0), ("B", 5.0)], "station_id string, v double")
    s = scaling.fit(df, ["v"], "station_wise")
    got = sorted(r.v for r in scaling.transform(df, s).collect())
    assert got == pytest.approx([-1 / math.sqrt(2), 0.0, 1 / math.sqrt(2)])
    other = spark.createDataFrame([("C", 3.0)], "station_id string, v double")
    assert scaling.transform(other, s).first().v == 0.0
    back = scaling.inverse(scaling.transform(df, s), s, {"v": "v"})
    assert sorted(r.v for r in back.collect()) == pytest.approx([1.0, 3.0, 5.0])
    assert scaling.fit(df, ["v"], "none") is None and set(s.state()["groups"]) == {"A", "B"}


def test_one_hot_levels(spark):
    df = spark.createDataFrame([("a",), (None,)], "c string")
    found = encode.levels(df, ["c"])
    assert found == {"c": ["a", "unknown"]}
    r = encode.one_hot(spark.createDataFrame([("z",)], "c string"), found).first()
    assert (r["static_cat__c__a"], r["static_cat__c__unknown"]) == (0.0, 0.0)


def test_service_pages_and_normalising(spark):
    served = {1: {"response": {"body": {"totalCount": 3, "items": {"item": [{"tm": "2024-01-01 00:00", "ta": "1.5"}, {"tm": "x", "ta": ""}]}}}}, 2: {"response": {"body": {"totalCount": 3, "items": {"item": {"tm": "2024-01-01 02:00", "zz": "7"}}}}}}
    items = list(webservice.pages(lambda p: served[p["pageNo"]], {}, 2))
    assert len(items) == 3
    raw = spark.createDataFrame([("108", i.get("tm"), i.get("ta"), i.get("zz")) for i in items], "station_id string, tm string, ta string, zz string")
    df = webservice.normalise(raw, "asos_hourly")
    assert df.columns[:8] == ["station_id", "datetime", "temp", "humidity", "pressure", "wind_speed", "precipitation", "quality_flag"] and df.columns[-1] == "zz"
    rows = df.collect()
    assert rows[0].temp == 1.5 and rows[1].datetime is None and rows[1].temp is None
    tz = timezone(timedelta(hours=9))
    assert len(webservice.spans("aws_minutely", datetime(2024, 1, 1, tzinfo=tz), datetime(2024, 1, 2, 12, tzinfo=tz))) == 2
    with pytest.raises(ValueError):
        webservice.spans("asos_hourly", START, START)
    with pytest.raises(ValueError):
        webservice.spans("other", START, START)


def test_tables_by_suffix(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    for name in ("t.csv", "t.parquet", "t.pq"):
        tables.write_table(df, str(tmp_path / name))
        assert tables.read_table(spark, str(tmp_path / name)).first().y == "a"
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "t.xls"))
    with pytest.raises(ValueError):
        tables.write_table(df, str(tmp_path / "t.xls"))
    with pytest.raises(ValueError):
        require(df, ["z"])
    assert list(netcdf.members(b"CDF")) == [b"CDF"]
    one = tables.cached_table(spark, str(tmp_path / "c"), {"a": 1}, lambda: df)
    two = tables.cached_table(spark, str(tmp_path / "c"), {"a": 2}, lambda: df.withColumn("x", F.lit(9)))
    assert (one.first().x, two.first().x) == (1, 9)


def test_config_merges_deeply(tmp_path):
    assert config.merged({"a": {"b": 1, "c": 2}, "d": [1]}, {"a": {"c": 3}, "d": [2]}) == {"a": {"b": 1, "c": 3}, "d": [2]}
    config.dump({"a": {"b": 1}}, tmp_path / "x.yaml")
    assert config.load(tmp_path / "x.yaml") == {"a": {"b": 1}}


def test_runs_and_aliases(tmp_path):
    a = experiments.run_directory(tmp_path, "a", {"x": 1}, {"best_val_loss": 2.0, "rmse": 1.0, "none": None})
    assert experiments.refresh_aliases(a) == ["latest", "best"]
    b = experiments.run_directory(tmp_path, "b", {"x": 1}, {"best_val_loss": 3.0, "rmse": 0.5})
    assert experiments.refresh_aliases(b) == ["latest"]
    assert json.loads((tmp_path / "best" / "experiment_summary.json").read_text())["best_val_loss"] == 2.0
    assert experiments.better({"best_val_loss": 1.0}, {"best_val_loss": float("nan")}, 1) and not experiments.better({"best_val_loss": 1.0}, {"best_val_loss": float("nan")}, 2)
    assert experiments.best_epoch([{"val_loss": 2.0}, {"val_loss": 1.0, "e": 1}])["e"] == 1


def fixture(spark):
    rows, era, off = [], [], {"108": 0.0, "159": 2.5}
    for s, o in off.items():
        for i in range(240):
            t = START + timedelta(hours=i)
            temp = 10 + o + 6 * math.sin(i / 12)
            rows.append((s, t, temp, min(max(55 + 3 * o + 15 * math.cos(i / 18), 0), 100), 1005 + 2 * math.sin(i / 24), 2.5 + math.cos(i / 10), 1.0 if i % 36 == 0 else 0.0, None))
            era.append((s, t, temp + 0.8))
    obs = observations.standardise(spark.createDataFrame(rows, "station_id string, datetime timestamp, temp double, humidity double, pressure double, wind_speed double, precipitation double, quality_flag string"), source_tz="UTC", source_name="asos")
    grid = spark.createDataFrame(era, "station_id string, datetime timestamp, era5_t2m double")
    st = metadata.enrich(spark.createDataFrame([(108, 37.5, 127.0, 38.0, "capital", 35.0), (159, 35.1, 129.0, 120.0, "coast", 1.0)], "station_id int, lat double, lon double, elevation double, region_class string, coastal_distance_km double"))
    return obs, grid, st


def test_second_version_end_to_end(spark):
    obs, grid, st = fixture(spark)
    data = {"target_name": "temp", "split": {"train_end": "2024-01-06 23:00:00", "val_end": "2024-01-08 23:00:00", "test_end": "2024-01-10 23:00:00"}, "feature_engineering": {"lag_features": {"target_value": [1, 24]}, "rolling_features": {"target_value": [3]}, "delta_features": {"target_value": [1]}}}
    table = training.training_table_v2(obs, grid, st, data).cache()
    assert table.count() == 480 and {"target_value_lag_24", "obs_dew_point_c", "era5_dew_point_c", "humidity_temp_interaction", "region"} <= set(table.columns)
    assert training.quality_report(table)["stations"][0]["missing_hour_count"] == 0
    features = {"encoder_continuous": ["target_value", "obs_humidity"], "decoder_known": ["hour_sin", "hour_cos"], "static_real": ["elevation"], "static_categorical": ["region"]}
    b = bundle.bundle_v2(table, features, {"encoder_length": 24, "prediction_length": 6}, scaled=["target_value", "obs_humidity"])
    assert {r.split: r["count"] for r in b.windows.groupBy("split").count().collect()} == {"train": 2 * (144 - 29), "val": 2 * 43, "test": 2 * 43}
    model = models.make("ridge", b.part("train"), b.encoder, b.targets, alpha=1.0)
    long = bundle.prediction_frame(model.predict(b.part("test")), b.targets, b.scaler, st).cache()
    assert long.count() == 2 * 43 * 6 and metrics.metrics(long).first().rmse < 1.0
    actual = long.join(table.select("station_id", F.col("datetime").alias("valid_time"), "target_value"), ["station_id", "valid_time"])
    assert actual.where("abs(actual - target_value) > 1e-6").count() == 0
    future = inference.forecast(b, model, "2024-01-10 23:00:00", st, limits=(0, 14), tz="Asia/Seoul").collect()
    assert len(future) == 12 and all(0 <= r.prediction <= 14 for r in future) and min(r.timestamp for r in future) == datetime(2024, 1, 11, 9)
    assert set(experiments.plot_data(long.withColumn("prediction_raw", F.col("prediction")))) == {"forecast_vs_actual", "horizon_error", "scatter", "raw_vs_corrected"}


def test_first_version_end_to_end(spark):
    obs, grid, st = fixture(spark)
    ends = {"train_end": "2024-01-06 23:00:00", "val_end": "2024-01-08 23:00:00", "test_end": "2024-01-10 23:00:00"}
    table = training.training_table_v1(obs, grid, st, ends)
    features = {"encoder_continuous": ["obs_temp", "obs_humidity"], "decoder_known": ["hour_sin"], "static_real": ["elevation"]}
    b = bundle.bundle_v1(table, features, ["target_temp", "target_humidity"], {"encoder_length": 6, "prediction_length": 3})
    assert b.part("val").count() == 2 * (48 - 8)
    model = models.make("persistence", b.part("train"), b.encoder, b.targets)
    long = bundle.prediction_frame(model.predict(b.part("val")), b.targets, b.scaler, st)
    assert {r.target_name for r in long.select("target_name").distinct().collect()} == {"temp", "humidity"}
    assert long.count() == 2 * 40 * 3 * 2


def test_stream_of_buckets_is_the_batch(spark, tmp_path):
    from skylattice.streaming.resample import resample_stream

    schema = "station_id string, datetime timestamp, temp double, humidity double, pressure double, wind_speed double, precipitation double, quality_flag string"
    df = spark.createDataFrame([("S", START + timedelta(minutes=25 * i), float(i), None, 1.0, 1.0, 0.1, "q") for i in range(20)], schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = resample_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "1h").writeStream.outputMode("complete").format("memory").queryName("buckets").start()
    q.processAllAvailable()
    q.stop()
    got = {r.datetime: r.temp for r in spark.table("buckets").collect()}
    assert got == {r.datetime: r.temp for r in resample.resample(df, "1h").collect()}


def test_union_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, "y")], "x int, z string")
    assert sorted((r.x, r.z) for r in merge.union_all([a, b]).collect()) == [(1, None), (2, "y")]


def test_feeds_of_one_priority_keep_their_order(spark, tmp_path):
    from skylattice.sources.observations import load_sources

    (tmp_path / "north.csv").write_text("station_id,datetime,temp,humidity\ns,2024-01-01 09:00:00,5.0,\ns,2024-01-01 09:00:00,1.0,40\n")
    (tmp_path / "south.csv").write_text("station_id,datetime,temp,humidity\ns,2024-01-01 09:00:00,2.0,30\n")
    feeds = [{"path": str(tmp_path / "north.csv"), "priority": 1}, {"csv": str(tmp_path / "south.csv"), "name": "south", "priority": 1}]
    row = load_sources(spark, feeds).first()
    assert (row.temp, row.humidity, row.observation_source, row.observation_sources) == (5.0, 40.0, "north", "north,south")
    with pytest.raises(ValueError, match="no observation source"):
        load_sources(spark, [])
    with pytest.raises(ValueError, match="has no path"):
        load_sources(spark, [{"name": "x"}])
    (tmp_path / "bare.csv").write_text("station_id,datetime\ns,2024-01-01 09:00:00\n")
    with pytest.raises(ValueError, match="temp"):
        load_sources(spark, [{"path": str(tmp_path / "bare.csv")}])


def test_gap_fill_is_linear_in_a_station(spark):
    import time

    df = spark.range(100_000).selectExpr("'s' AS station_id", "timestamp_seconds(id * 3600) AS datetime", "CASE WHEN id % 7 = 0 THEN CAST(id AS DOUBLE) END AS obs_temp")
    began = time.time()
    got = gapfill.fill_gaps(df, ["obs_temp"]).selectExpr("sum(abs(obs_temp - least(unix_timestamp(datetime) / 3600, 99995)))", "count(obs_temp)").first()
    assert got[0] == pytest.approx(0, abs=1e-3) and got[1] == 100_000
    assert time.time() - began < 60
