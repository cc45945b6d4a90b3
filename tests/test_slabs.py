"""Slabs of a station give what one window over it gives, for any length of slab."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from skylattice.operators import gapfill, lags, models, slabs, windows
from skylattice.plans import bundle, inference

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(4)
    rows = []
    for s, n in (("a", 300), ("b", 1), (None, 40), ("c", 90)):
        hour = 0
        for i in range(n):
            hour += 1 if rng.random() < 0.8 else rng.choice([2, 50])
            gap = s == "c" and 20 <= i < 70
            rows.append((s, START + datetime.timedelta(hours=hour), None if gap or rng.random() < 0.4 else rng.random(), None if s == "b" else rng.random(), "train" if i < n * 0.6 else "test"))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "station_id string, datetime timestamp, temp double, obs_temp double, split string").cache()


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("rows", [1, 2, 7, 64, 1000])
def test_gap_fill_in_slabs(series, rows):
    assert rows_of(gapfill.fill_gaps(series, ["temp", "obs_temp"], 3, slab_rows=rows)) == rows_of(gapfill.fill_gaps(series, ["temp", "obs_temp"], 3))


@pytest.mark.parametrize("rows", [6, 7, 50, 1000])
def test_lags_in_slabs(series, rows):
    specs = ({"temp": [1, 6]}, {"temp": [2, 5]}, {"obs_temp": [3]})
    for exact in (False, True):
        assert rows_of(lags.lag_features(series, *specs, exact_hours=exact, slab_rows=rows)) == rows_of(lags.lag_features(series, *specs, exact_hours=exact))
    with pytest.raises(ValueError, match="shorter"):
        lags.lag_features(series, *specs, slab_rows=5)


@pytest.mark.parametrize("rows", [5, 11, 400])
@pytest.mark.parametrize("contiguous", [True, False])
def test_windows_in_slabs(series, rows, contiguous):
    make = lambda **k: windows.sliding(series, ["temp", "obs_temp"], ["obs_temp"], [], ["temp"], 4, 2, contiguous=contiguous, **k)
    got = make(slab_rows=rows)
    assert got.columns == make().columns and rows_of(got) == rows_of(make())


def test_numbers_and_tasks(spark, series):
    got = slabs.numbered(series, 16).where("station_id = 'a'").orderBy("datetime").collect()
    assert [r[slabs.NUMBER] for r in got] == list(range(300)) and {r[slabs.SLAB] for r in got} == set(range(19))
    assert slabs.numbered(series.limit(0), 16).collect() == []
    odd = spark.createDataFrame([("a", None), ("a", None), ("a", START), ("a", START), ("a", datetime.datetime(1900, 1, 1))], "station_id string, datetime timestamp")
    assert sorted(r[slabs.NUMBER] for r in slabs.numbered(odd, 2).collect()) == [0, 1, 2, 3, 4]
    long = spark.range(20_000).select(F.lit("x").alias("station_id"), F.timestamp_seconds(F.col("id") * 3600).alias("datetime"), F.when(F.col("id") % 1000 == 0, F.col("id").cast("double")).alias("temp"))
    filled = gapfill.fill_gaps(long, ["temp"], 5000, slab_rows=500)
    assert filled.where("abs(temp - unix_seconds(datetime) / 3600) > 1e-6 and unix_seconds(datetime) / 3600 <= 19000").count() == 0


def test_many_start_times_at_once(spark, series):
    rows = series.where("datetime is not null").withColumn("datetime", F.col("datetime").cast("timestamp"))
    times = [START + datetime.timedelta(hours=h, minutes=m) for h, m in ((-5, 0), (3, 0), (30, 0), (30, 30), (200, 0), (9000, 0))]
    got = inference.latest_rows(rows, spark.createDataFrame([(t,) for t in [*times, times[0], None]], "init timestamp"), 5)
    for t in times:
        one = inference.history(rows, str(t), 5)
        assert rows_of(got.where(F.col("init") == F.lit(str(t)).cast("timestamp")).drop("init").select(*one.columns).where("station_id is not null")) == rows_of(one.where("station_id is not null"))
    st = spark.createDataFrame([("a", "x"), ("c", "y")], "station_id string, region string")
    b = bundle.Bundle(rows, rows, None, ("obs_temp",), ("obs_temp",), (), ("obs_temp",), 3, 2)
    model = models.make("persistence", None, ["obs_temp"], ["obs_temp"])
    for strict in (True, False):
        many = inference.forecasts(b, model, spark.createDataFrame([(t,) for t in times], "init timestamp"), st, limits=(0.1, 0.9), strict=strict)
        single = [r for t in times for r in rows_of(inference.forecast(b, model, str(t), st, limits=(0.1, 0.9), strict=strict))]
        assert sorted(single) == rows_of(many.drop("init").where("station_id is not null")) or sorted(r for r in single if "station_id=None" not in r) == rows_of(many.drop("init").where("station_id is not null"))


@pytest.mark.parametrize(("shortest", "longest", "horizon", "first", "last_only"), [(None, 4, 2, None, False), (1, 5, 3, None, False), (2, 4, 1, 30, False), (1, 6, 2, None, True)])
def test_varying_windows_by_brute_force(spark, shortest, longest, horizon, first, last_only):
    rng = random.Random(longest)
    rows = [(s, i, START + datetime.timedelta(hours=i), float(i), "train" if i < 25 else "val") for s in "ab" for i in range(60) if rng.random() < 0.85]
    rows += [("a", None, START, -1.0, "train"), ("c", 1, START, 1.0, "val")]
    df = spark.createDataFrame(rows, "station_id string, time_idx long, datetime timestamp, v double, split string")
    want = []
    for s in "abc":
        have = {i: v for k, i, _, v, _ in rows if k == s and i is not None}
        found = []
        for p in have:
            n = 0
            while n < longest and p - n - 1 in have:
                n += 1
            if n >= (shortest or longest) and all(p + h in have for h in range(horizon)) and (first is None or p >= first):
                encoder = [[have[p - n + i], 1.0] for i in range(n)] + [[0.0, 0.0]] * (longest - n)
                found.append((s, p, n, encoder, [[have[p + h]] for h in range(horizon)]))
        want += [max(found, key=lambda x: x[1])] if last_only and found else [] if last_only else found
    got = windows.varying(df.withColumn("one", F.lit(1)), ["v", "one"], ["v"], [], ["v"], longest, horizon, shortest, first, last_only)
    assert sorted((r.station_id, r.prediction_idx, r.encoder_length, r.encoder, r.target) for r in got.collect()) == sorted(want)
    with pytest.raises(ValueError, match="encoders"):
        windows.varying(df, ["v"], [], [], ["v"], 2, 1, shortest=3)


def test_split_windows_reach_back(spark):
    """Six rows back and three ahead over 30 hourly rows a station: the splits' windows, with and without shorter encoders."""
    rows = [(s, i, START + datetime.timedelta(hours=i), float(i), "train" if i < 15 else "val" if i < 22 else "test") for s in "ab" for i in range(30)]
    df = spark.createDataFrame(rows, "station_id string, time_idx long, datetime timestamp, v double, split string")
    b = bundle.Bundle(df, df, None, ("v",), (), (), ("v",), 6, 3)
    assert [bundle.split_windows(b, x).count() for x in bundle.SPLITS] == [2 * (15 - 8), 2 * (7 - 2), 2 * (8 - 2)]
    assert bundle.split_windows(b, "train", shortest=1).count() == 2 * (15 - 3)
    last = bundle.split_windows(b, "test", last_only=True).collect()
    assert sorted((r.station_id, r.prediction_idx, r.encoder_length) for r in last) == [("a", 27, 6), ("b", 27, 6)]
