"""M6, M9: a feed-forward network over windows, trained by gradients that partitions sum and the driver applies."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .windows import flattened

#: Values of a tile: gradients travel, and are added, in tiles.
TILE = 8192
#: Fixed: the decay of Adam's two averages, and what keeps its quotient finite.
DECAY, SQUARES, LEAST = 0.9, 0.999, 1e-8


@dataclass(frozen=True)
class Network:
    """Three linear layers with rectifiers between; an output is a step and target, step first.

    `history` has epoch, train_loss and val_loss of each epoch, `best_epoch` the one whose weights these are (None if no
    validation loss was finite; the last ones stay then).
    """

    layers: tuple[tuple[np.ndarray, np.ndarray], ...]
    horizon: int
    history: tuple[dict, ...] = field(default=())
    best_epoch: int | None = None

    @property
    def best_val_loss(self) -> float:
        return min((h["val_loss"] for h in self.history if h["epoch"] == self.best_epoch), default=float("inf"))

    def predict(self, windows: DataFrame) -> DataFrame:
        """Adds `predicted`, horizon x targets; null for a window with a null feature."""
        layers, horizon, names = self.layers, self.horizon, windows.columns
        schema = T.StructType([*windows.schema.fields, T.StructField("predicted", T.ArrayType(T.ArrayType(T.DoubleType())))])
        outputs = layers[-1][1].shape[0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b.column(len(names)), layers[0][0].shape[0])
                y = forward(layers, x)[-1].reshape(len(x), horizon, outputs // horizon)
                known = ~np.isnan(y).any((1, 2))
                rows = [v if k else None for v, k in zip(y.tolist(), known)]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(rows, pa.list_(pa.list_(pa.float64())))], names=[*names, "predicted"])

        return flattened(windows).select(*names, "features").mapInArrow(run, schema)

    def dumped(self) -> str:
        """The model as JSON; `loaded` takes it back, and `fit_network` goes on from it."""
        layers = [[w.tolist(), b.tolist()] for w, b in self.layers]
        return json.dumps({"layers": layers, "horizon": self.horizon, "history": list(self.history), "best_epoch": self.best_epoch})

    @classmethod
    def loaded(cls, text: str) -> Network:
        d = json.loads(text)
        return cls(tuple((np.array(w), np.array(b)) for w, b in d["layers"]), d["horizon"], tuple(d["history"]), d["best_epoch"])


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width from a column of lists; nulls are NaN."""
    return np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def fresh(features: int, hidden: int, outputs: int, seed: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """Layers drawn evenly within one over the root of what enters them."""
    rng = np.random.default_rng(seed)
    sizes = [(features, hidden), (hidden, hidden), (hidden, outputs)]
    return tuple((rng.uniform(-1, 1, (a, b)) / np.sqrt(max(a, 1)), rng.uniform(-1, 1, b) / np.sqrt(max(a, 1))) for a, b in sizes)


def forward(layers: Sequence, x: np.ndarray, kept: np.ndarray | None = None) -> list[np.ndarray]:
    """Both hidden layers and the output; `kept` multiplies the first hidden layer."""
    (w1, b1), (w2, b2), (w3, b3) = layers
    first = np.maximum(x @ w1 + b1, 0.0)
    if kept is not None:
        first = first * kept
    second = np.maximum(first @ w2 + b2, 0.0)
    return [first, second, second @ w3 + b3]


def gradient(layers: Sequence, x: np.ndarray, y: np.ndarray, kept: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """The gradient of the summed squared error over all weights, in one vector, and that error."""
    first, second, out = forward(layers, x, kept)
    error = out - y
    down = 2.0 * error
    grads = [(second.T @ down, down.sum(0))]
    down = (down @ layers[2][0].T) * (second > 0)
    grads.append((first.T @ down, down.sum(0)))
    down = (down @ layers[1][0].T) * (first > 0)
    if kept is not None:
        down = down * kept
    grads.append((x.T @ down, down.sum(0)))
    return np.concatenate([v.ravel() for pair in reversed(grads) for v in pair]), float(np.square(error).sum())


def mixed(keys: np.ndarray) -> np.ndarray:
    """64 random bits for each key: splitmix64."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def dropout(rows: np.ndarray, units: int, rate: float, seed: int) -> np.ndarray | None:
    """0 or 1 / (1 - rate) for each row and unit. It follows from the row's key, the unit and the seed, so partitions don't matter."""
    if not rate:
        return None
    row = mixed(rows.view(np.uint64) ^ mixed(np.array([seed], np.uint64)))
    drawn = mixed(row[:, None] ^ mixed(np.arange(units, dtype=np.uint64))[None, :]) >> np.uint64(11)
    return (drawn.astype(np.float64) / 2.0**53 >= rate) / (1.0 - rate)


def summed(rows: DataFrame, layers: Sequence, rate: float | None, seed: int) -> tuple[np.ndarray | None, float, int]:
    """Gradient (`rate` None: none), squared error and number of values over all rows.

    A partition sends its sums once, in tiles; a tile is added up by an aggregate of its own. What comes to the driver is as
    long as the weights, whatever the rows.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    shared = rows.sparkSession.sparkContext.broadcast(layers)
    features, outputs = layers[0][0].shape[0], layers[-1][1].shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers = shared.value
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            x, y = matrix(b.column(0), features), matrix(b.column(1), outputs)
            if rate is None:
                part = np.array([np.square(forward(layers, x)[-1] - y).sum(), y.size])
            else:
                got, error = gradient(layers, x, y, dropout(b.column(2).to_numpy(), layers[0][1].shape[0], rate, seed))
                part = np.concatenate([[error, y.size], got])
            total = part if total is None else total + part
        if total is not None:
            at = range(0, len(total), TILE)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([total[k : k + TILE] for k in at], pa.list_(pa.float64()))], names=["tile", "part"])

    parts = rows.select("features", "y", "row").mapInArrow(run, "tile long, part array<double>")
    tiles = parts.groupBy("tile").agg(Summarizer.sum(array_to_vector("part")).alias("part")).orderBy("tile").collect()
    shared.unpersist()
    if not tiles:
        return None, float("nan"), 0
    total = np.concatenate([t.part.toArray() for t in tiles])
    return (total[2:] if rate is not None else None), float(total[0]), int(total[1])


def complete(windows: DataFrame, steps: int, seed: int) -> DataFrame:
    """features, y, row (a key of the window's place and time), step (of an epoch); windows with a null value are passed over."""
    key = F.xxhash64(F.lit(seed), *[F.col(c) for c in ("station_id", "prediction_start") if c in windows.columns], "encoder", "decoder", "static", "target")
    flat = flattened(windows).select("features", F.flatten("target").alias("y"), key.alias("row"), F.size("target").alias("h"))
    known = lambda c: F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v))
    return flat.where(known("features") & known("y")).withColumn("step", F.pmod(F.xxhash64("row"), F.lit(steps)))


def fit_network(
    windows: DataFrame,
    validation: DataFrame | None = None,
    hidden: int = 32,
    rate: float = 0.1,
    epochs: int = 20,
    learning_rate: float = 1e-3,
    steps: int = 1,
    patience: int = 3,
    seed: int = 42,
    start: Network | None = None,
) -> Network:
    """M6: mean squared error, Adam, early stop on the validation loss, and the best epoch's weights.

    An epoch takes every training window once, in `steps` parts dealt by a hash of the window; each part's gradient is one
    pass that partitions sum. Windows, the parts and the dropout depend on the window alone, so partitions change a result
    by the order of sums only. `start` (M9) goes on from a saved network's weights with fresh averages.
    Without validation windows the loss is NaN, which never is the best: training stops after `patience` epochs.
    """
    train = complete(windows, steps, seed)
    train = train.sortWithinPartitions("step").persist() if steps > 1 else train.persist()
    held = complete(validation, 1, seed).persist() if validation is not None else None
    try:
        shape = train.select(F.size("features").alias("n"), F.size("y").alias("m"), "h").first()
        if shape is None:
            raise ValueError("no training windows")
        if start is not None and (start.layers[0][0].shape[0], start.layers[-1][1].shape[0]) != (shape.n, shape.m):
            raise ValueError("the saved network has other features or outputs")
        layers = start.layers if start is not None else fresh(shape.n, hidden, shape.m, seed)
        flat = np.concatenate([v.ravel() for pair in layers for v in pair])
        first, second = np.zeros_like(flat), np.zeros_like(flat)
        best, best_epoch, best_loss, stale, moves, history = layers, None, float("inf"), 0, 0, []
        for epoch in range(1, epochs + 1):
            error = count = 0
            for step in range(steps):
                part = train.where(F.col("step") == step) if steps > 1 else train
                grad, lost, values = summed(part, layers, rate, seed * 1_000_003 + epoch)
                if not values:
                    continue
                moves += 1
                grad = grad / values
                first = DECAY * first + (1 - DECAY) * grad
                second = SQUARES * second + (1 - SQUARES) * grad * grad
                flat = flat - learning_rate * (first / (1 - DECAY**moves)) / (np.sqrt(second / (1 - SQUARES**moves)) + LEAST)
                layers = shaped(flat, layers)
                error, count = error + lost, count + values
            _, lost, values = summed(held, layers, None, 0) if held is not None else (None, float("nan"), 1)
            loss = lost / values if values else float("nan")
            history.append({"epoch": epoch, "train_loss": error / count, "val_loss": loss})
            if loss < best_loss:
                best, best_epoch, best_loss, stale = layers, epoch, loss, 0
            else:
                stale += 1
                if stale >= patience:
                    break
        return Network(best if best_epoch is not None else layers, shape.h, tuple(history), best_epoch)
    finally:
        train.unpersist()
        if held is not None:
            held.unpersist()


def shaped(flat: np.ndarray, layers: Sequence) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """`flat` cut into the shapes of `layers`."""
    out, at = [], 0
    for pair in layers:
        made = []
        for v in pair:
            made.append(flat[at : at + v.size].reshape(v.shape))
            at += v.size
        out.append(tuple(made))
    return tuple(out)


def settings_of(settings: Mapping) -> dict:
    """The keywords of `fit_network` among a model's settings."""
    kinds = {"hidden": int, "rate": float, "epochs": int, "learning_rate": float, "steps": int, "patience": int, "seed": int}
    return {k: kind(settings[k]) for k, kind in kinds.items() if k in settings}
