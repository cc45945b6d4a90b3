"""Runs, leaderboards and aliases on the session's file system."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

import pytest

from skylattice.plans import experiments
from skylattice.sources import store


def test_files_appear_whole(spark, tmp_path):
    root = str(tmp_path / "x")
    store.put_text(spark, f"{root}/a.txt", "one\ntwo é\n")
    store.put_text(spark, f"{root}/a.txt", "three\n")
    assert store.get_text(spark, f"{root}/a.txt") == "three\n" and store.get_text(spark, f"{root}/b.txt") is None
    assert store.children(spark, root) == ["a.txt"] and store.children(spark, f"{root}/none") == []
    store.publish(spark, root, "run", {"t.json": "{}"}, {"rows": spark.range(3)})
    assert spark.read.option("header", True).csv(f"{root}/run/rows.csv").count() == 3
    with pytest.raises(Exception, match="exist"):
        store.publish(spark, root, "run", {"t.json": "[]"})
    assert store.get_text(spark, f"{root}/run/t.json") == "{}"


def test_appends_at_one_time_all_stay(spark, tmp_path):
    board = str(tmp_path / "board")
    assert store.appended(spark, board) is None
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: store.append(spark.range(i, i + 1).withColumnRenamed("id", "a" if i % 2 else "b"), board), range(12)))
    rows = store.appended(spark, board).collect()
    assert sorted(x for r in rows for x in r if x is not None) == list(range(12))


def test_runs_are_published(spark, tmp_path):
    root = str(tmp_path / "runs")
    assert experiments.boards(spark, root) == {}
    table = spark.createDataFrame([("s", "train", "2024-01-01 00:00:00"), ("s", "test", "2024-01-02 00:00:00")], "station_id string, split string, datetime string").selectExpr("station_id", "split", "cast(datetime as timestamp) datetime")
    frame = lambda e: spark.createDataFrame([("s", h, t, 1.0 + e, 1.0, "winter") for h in (1, 2) for t in ("temp", "humidity")], "station_id string, horizon_step int, target_name string, prediction double, actual double, season string").selectExpr("*", "timestamp'2024-01-02 00:00:00' prediction_start", "timestamp'2024-01-02 01:00:00' valid_time")
    for name, error in (("first", 2.0), ("better", 0.5), ("worse", 1.0)):
        experiments.publish_run(spark, root, name, {"a": 1}, {"rmse": error, "best_val_loss": error, "model_name": name, "version": 2}, table, frame(error))
    assert (store.pointed(spark, root, "latest"), store.pointed(spark, root, "best"), store.pointed(spark, root, "other")) == ("worse", "better", None)
    assert json.loads(store.get_text(spark, f"{root}/first/config_snapshot.json")) == {"a": 1}
    report = store.get_text(spark, f"{root}/first/report.md")
    assert "# first" in report and "- rmse: 2.0000" in report and "## by_station" in report and "| temp | s |" in report
    found = experiments.boards(spark, root)
    assert set(found) == {"all", "temp", "humidity"} and found["all"].count() == 6
    assert found["all"].columns == experiments.LEADERBOARD
    assert {(r.model_name, r.rmse) for r in found["temp"].collect()} == {("first", 2.0), ("better", 0.5), ("worse", 1.0)}
    csv = spark.read.option("header", True).csv(f"{root}/better/by_horizon.csv").collect()
    assert {(r.target_name, r.horizon_step, float(r.rmse)) for r in csv} == {(t, h, 0.5) for t in ("temp", "humidity") for h in "12"}
    with pytest.raises(Exception, match="exist"):
        experiments.publish_run(spark, root, "first", {}, {}, table, frame(0.0))
