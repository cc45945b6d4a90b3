"""The network, trees by leaves, their saving, and the cell index of places, against plain restatements."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators import boosting, models, network, spatial

WINDOW = "station_id string, prediction_start timestamp, encoder array<array<double>>, decoder array<array<double>>, static array<double>, target array<array<double>>"


def windows(spark, n=200, seed=0, null=False):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        e, d, s = rng.normal(size=(3, 2)).round(2), rng.normal(size=(2, 1)).round(2), rng.normal(size=1).round(1)
        y = np.array([[e[-1, 0] * 2 + (d[0, 0] > 0)], [e[0, 1] - s[0] + rng.normal() * 0.1]])
        rows.append((f"s{i % 7}", None, e.tolist(), d.tolist(), s.tolist(), y.tolist()))
    if null:
        rows.append(("s0", None, [[None, 1.0], [1.0, 1.0], [1.0, 1.0]], [[0.0], [0.0]], [0.0], [[1.0], [1.0]]))
    return spark.createDataFrame(rows, WINDOW)


def arrays(df):
    rows = df.collect()
    x = np.array([[v for r in (*r.encoder, *r.decoder) for v in r] + list(r.static) for r in rows])
    return x, np.array([[v for t in r.target for v in t] for r in rows]), rows


def test_gradient_is_that_of_the_error():
    rng = np.random.default_rng(1)
    layers = network.fresh(5, 4, 3, 1)
    x, y = rng.normal(size=(6, 5)), rng.normal(size=(6, 3))
    kept = network.dropout(np.arange(6, dtype=np.int64), 4, 0.3, 9)
    assert set(np.unique(kept)) <= {0.0, 1 / 0.7}
    got, error = network.gradient(layers, x, y, kept)
    flat = np.concatenate([v.ravel() for pair in layers for v in pair])
    loss = lambda f: np.square(network.forward(network.shaped(f, layers), x, kept)[-1] - y).sum()
    assert error == pytest.approx(loss(flat))
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert got[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-6, abs=1e-5)


def test_network_training_restated(spark):
    """Adam on the whole set's gradient, in NumPy alone; no dropout, one step an epoch."""
    df = windows(spark)
    got = network.fit_network(df, df, hidden=6, rate=0.0, epochs=5, learning_rate=0.02, seed=3)
    x, y, rows = arrays(df)
    layers = network.fresh(x.shape[1], 6, y.shape[1], 3)
    flat = np.concatenate([v.ravel() for pair in layers for v in pair])
    m = v = np.zeros_like(flat)
    for t in range(1, 6):
        g = network.gradient(network.shaped(flat, layers), x, y)[0] / y.size
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        flat = flat - 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    want = network.shaped(flat, layers)
    for a, b in zip(got.layers, want):
        np.testing.assert_allclose(a[0], b[0], atol=1e-10)
        np.testing.assert_allclose(a[1], b[1], atol=1e-10)
    shown = network.forward(want, x)[-1]
    for r, p in zip(got.predict(df).select("predicted").collect(), shown):
        np.testing.assert_allclose(np.ravel(r.predicted), p, atol=1e-10)
    assert got.best_epoch == 5 and got.best_val_loss == pytest.approx(np.square(shown - y).mean())


def test_network_whatever_the_partitions(spark):
    fits = [network.fit_network(windows(spark, null=True).repartition(n), windows(spark, 50, 5), hidden=5, rate=0.4, epochs=4, steps=3, learning_rate=0.01) for n in (1, 8)]
    assert [h["train_loss"] for h in fits[0].history] == pytest.approx([h["train_loss"] for h in fits[1].history], abs=1e-9)
    assert [h["val_loss"] for h in fits[0].history] == pytest.approx([h["val_loss"] for h in fits[1].history], abs=1e-9)


def test_network_stops_resumes_and_is_saved(spark, tmp_path):
    df = windows(spark)
    stopped = network.fit_network(df, windows(spark, 60, 8), hidden=4, epochs=30, learning_rate=0.9, patience=2)
    assert len(stopped.history) < 30
    losses = [h["val_loss"] for h in stopped.history]
    assert losses[stopped.best_epoch - 1] == min(losses) == stopped.best_val_loss
    alone = network.fit_network(df, None, hidden=4, epochs=9, patience=3)
    assert alone.best_epoch is None and len(alone.history) == 3 and math.isnan(alone.history[0]["val_loss"])
    models.save(stopped, spark, str(tmp_path / "m"))
    again = models.load(spark, str(tmp_path / "m"))
    assert again.history == stopped.history
    null = windows(spark, 3, 4, null=True)
    assert [r.predicted for r in again.predict(null).collect()] == [r.predicted for r in stopped.predict(null).collect()]
    assert again.predict(null).collect()[-1].predicted is None
    more = models.make("tft", df, [], [], validation=df, start=again, epochs=3, learning_rate=0.001, dropout=0.0)
    assert more.history[0]["train_loss"] < stopped.history[0]["train_loss"]
    with pytest.raises(ValueError, match="other features"):
        network.fit_network(df.withColumn("static", F.array()), df, start=again)
    with pytest.raises(ValueError, match="no training"):
        network.fit_network(df.limit(0))


def test_backends_are_resolved():
    assert models.resolved("tft", {})["backend"] == "fallback_torch"
    asked = models.resolved("tft", {"backend": "pytorch_forecasting", "allow_fallback_backend": True, "hidden_size": 8})
    assert (asked["requested_backend"], asked["backend"], asked["type"], asked["hidden"]) == ("pytorch_forecasting", "fallback_torch", "network", 8)
    assert models.resolved("ridge", {"alpha": 2})["type"] == "ridge"
    with pytest.raises(RuntimeError):
        models.resolved("tft", {"backend": "pytorch_forecasting"})
    with pytest.raises(ValueError, match="backend"):
        models.resolved("tft", {"backend": "abacus"})


def plain_boosting(x, y, edges, trees, leaves, rate, least_rows):
    """One output, rows and all cuts in plain loops: the leaf of greatest gain is split, first feature and lowest border of equal ones."""
    score = np.full(len(y), y.mean())
    for _ in range(trees):
        g, parts = score - y, [np.arange(len(y))]
        found = {}

        def best(rows, g=g, found=found):
            key = tuple(rows)
            if key not in found:
                found[key] = None
                for f in range(x.shape[1]):
                    for e in edges[f]:
                        left = x[rows, f] <= e
                        a, b = rows[left], rows[~left]
                        if len(a) >= least_rows and len(b) >= least_rows:
                            gain = g[a].sum() ** 2 / len(a) + g[b].sum() ** 2 / len(b) - g[rows].sum() ** 2 / len(rows)
                            if gain > 1e-9 and (found[key] is None or gain > found[key][0] + 1e-9):
                                found[key] = (gain, a, b)
            return found[key]

        while len(parts) < leaves:
            open_ = [i for i in range(len(parts)) if best(parts[i])]
            if not open_:
                break
            i = max(open_, key=lambda i: best(parts[i])[0])
            _, a, b = best(parts[i])
            parts[i : i + 1] = [a, b]
        for rows in parts:
            score[rows] -= rate * g[rows].mean()
    return score


@pytest.mark.parametrize(("leaves", "bins", "parts"), [(15, 16, 1), (7, 63, 5), (2, 8, 3)])
def test_leaves_by_brute_force(spark, monkeypatch, leaves, bins, parts):
    monkeypatch.setattr(boosting, "CUT_EVERY", 2)
    monkeypatch.setattr(boosting, "BLOCK", 4)
    monkeypatch.setattr(boosting, "HELD", 1)
    df = windows(spark, null=True).repartition(parts)
    model = boosting.fit_leaves(df, trees=4, leaves=leaves, rate=0.3, bins=bins, least_rows=5)
    x, y, rows = arrays(df)
    whole = ~np.isnan(x.astype(float)).any(1)
    x, y = x[whole].astype(float), y[whole]
    edges = [np.unique([np.sort(x[:, f])[max(0, math.ceil(len(x) * k / bins) - 1)] for k in range(1, bins)]) for f in range(x.shape[1])]
    got = {tuple(np.ravel(r.encoder)): r.predicted for r in model.predict(df).collect()}
    for o in range(2):
        want = plain_boosting(x, y[:, o], edges, 4, leaves, 0.3, 5)
        np.testing.assert_allclose([got[tuple(v[:6])][o][0] for v in x], want, atol=1e-9)
        assert all(len([f for f in t["feature"] if f < 0]) <= leaves for t in model.trees[o])
    assert [p for p in got.values() if p is None] == [None]


def test_leaves_resume_and_are_saved(spark, tmp_path):
    df = windows(spark)
    edges = [[-1.0, 0.0, 1.0]] * 9
    whole = models.make("lightgbm", df, [], [], params={"n_estimators": 4, "num_leaves": 5, "learning_rate": 0.5}, edges=edges)
    half = boosting.fit_leaves(df, trees=2, leaves=5, rate=0.5, edges=edges)
    models.save(half, spark, str(tmp_path / "m"))
    more = models.make("boosted_leaves", df, [], [], trees=2, leaves=5, rate=0.5, edges=edges, start=models.load(spark, str(tmp_path / "m")))
    a, b = ([r.predicted for r in m.predict(df).collect()] for m in (whole, more))
    np.testing.assert_allclose(a, b, atol=1e-9)
    used = whole.importance([f"f{i}" for i in range(9)], ["y"])
    assert [r[:2] for r in used] == [("y", 1)] * 9 + [("y", 2)] * 9 and used[0][2] == "f4" and sum(r[4] for r in used) == sum(f >= 0 for own in whole.trees for t in own for f in t["feature"])
    with pytest.raises(ValueError, match="no training"):
        boosting.fit_leaves(df.limit(0))


@pytest.mark.parametrize("kind", ["persistence", "ridge", "boosted_trees"])
def test_other_models_are_saved(spark, tmp_path, kind):
    df = windows(spark, 40)
    model = models.make(kind, df, ["target_a", "b"], ["target_a"], trees=2, depth=2)
    models.save(model, spark, str(tmp_path / "m"))
    models.save(model, spark, str(tmp_path / "m"))
    show = lambda m: [r.predicted for r in m.predict(df).collect()]
    assert show(models.load(spark, str(tmp_path / "m"))) == show(model)


def plain_places(grid, stations, mode):
    out = {}
    for t in {g[0] for g in grid}:
        at = {(a, b): v for u, a, b, v in grid if u == t}
        for sid, lat, lon in stations:
            near = min(at, key=lambda p: ((p[0] - lat) * (p[0] - lat) + (p[1] - lon) * (p[1] - lon), p))
            value = at[near]
            if mode == "bilinear":
                lats, lons = sorted({p[0] for p in at}), sorted({p[1] for p in at})
                lo = [max((v for v in axis if v < s), default=None) for axis, s in ((lats, lat), (lons, lon))]
                hi = [min((v for v in axis if v >= s), default=None) for axis, s in ((lats, lat), (lons, lon))]
                corners = [(a, b) for a in (lo[0], hi[0]) for b in (lo[1], hi[1])]
                if all(c in at for c in corners):
                    y, x = (lat - lo[0]) / (hi[0] - lo[0]), (lon - lo[1]) / (hi[1] - lo[1])
                    a, b, c, d = (at[k] for k in corners)
                    value = a * (1 - y) * (1 - x) + c * y * (1 - x) + b * (1 - y) * x + d * y * x
            out[sid, t] = value
    return out


def grids():
    rng = random.Random(5)
    square = [(0, a / 2, b / 2) for a in range(12) for b in range(9)]
    holes = [(1, a / 4, b / 4) for a in range(20) for b in range(20) if rng.random() < 0.4]
    clusters = [(2, rng.gauss(0, 0.01), rng.gauss(0, 0.01)) for _ in range(60)] + [(2, 50 + rng.gauss(0, 0.01), 80 + rng.gauss(0, 0.01)) for _ in range(60)]
    line = [(3, 1.0, b / 3) for b in range(15)]
    one = [(4, 2.0, 3.0)]
    return [square, holes, clusters, line, one]


@pytest.mark.parametrize("mode", ["nearest", "bilinear"])
def test_places_by_brute_force(spark, mode):
    rng = random.Random(6)
    stations = [(f"s{i}", rng.uniform(-1, 7), rng.uniform(-1, 7)) for i in range(60)] + [("on", 1.0, 1.0), ("mid", 0.25, 0.25), ("far", -80.0, 170.0), ("north", 90.0, 2.0), ("between", 25.0, 40.0), ("edge", 0.0, 4.0)]
    points = [p for g in grids() for p in dict.fromkeys(g)]
    rows = [(f"2024-01-0{t + 1} 00:00:00", a, b, rng.random()) for t, a, b in points]
    grid = spark.createDataFrame(rows, "datetime string, lat double, lon double, v double")
    got = spatial.at_stations(grid, spark.createDataFrame([*stations, ("none", None, 1.0)], "station_id string, lat double, lon double"), mode)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    found = {(r.station_id, str(r.datetime)): r.v for r in got.collect()}
    want = plain_places(rows, stations, mode)
    assert found.keys() == want.keys()
    assert {k: round(v, 9) for k, v in found.items()} == {k: round(v, 9) for k, v in want.items()}


@pytest.mark.parametrize(("block", "held"), [(3, 1), (4, 4000), (256, 32 << 20)])
def test_ridge_by_blocks_and_products(spark, monkeypatch, block, held):
    df = windows(spark).repartition(3)
    x, y, _ = arrays(df)
    z = np.column_stack([x, np.ones(len(x))])
    pull = 2.0 * np.eye(z.shape[1])
    pull[-1, -1] = 0
    want = np.linalg.solve(z.T @ z + pull, z.T @ y)
    monkeypatch.setattr(models, "BLOCK", block)
    monkeypatch.setattr(models, "HELD", held)
    for solved in (1 << 30, 0):
        monkeypatch.setattr(models, "SOLVED", solved)
        got = models.fit_ridge(df, 2.0)
        np.testing.assert_allclose(got.weights, want[:-1], atol=1e-9)
        np.testing.assert_allclose(got.bias, want[-1], atol=1e-9)


def test_a_stump_without_an_allowed_border_gives_no_row(spark, tmp_path):
    """where no border leaves enough rows on both sides, the query has no rows, as its SQL."""
    import duckdb

    from skylattice.queries import station

    con = duckdb.connect()
    con.execute("""CREATE VIEW events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_hours(i // 2) + to_minutes(1) AS ts, i % 50 AS user_id,
        CASE i % 2 WHEN 0 THEN 'view' ELSE 'click' END AS event_type, 50.0::DOUBLE + i % 40 AS value, '{"k": 1}' AS props FROM (SELECT range::BIGINT AS i FROM range(600))""")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    assert con.execute(station.ORACLES["m4_stump"]).fetchall() == []
    assert station.m4_stump(spark, str(tmp_path)).collect() == []


def test_training_rows_are_dealt_by_their_size(spark, monkeypatch):
    """mostly empty parts of a shuffle don't cost a task in every pass of a model; all rows stay."""
    from skylattice.operators import durable

    rows = spark.range(500).repartition(40)
    made = durable.dealt(rows, 3)
    assert made.rdd.getNumPartitions() == 1 and made.count() == 500
    monkeypatch.setattr(durable, "VALUES", 300)
    made = durable.dealt(rows, 3)
    assert made.rdd.getNumPartitions() == 5 and sorted(r.id for r in made.collect()) == list(range(500))
