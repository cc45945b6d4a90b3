"""Forecasts from windows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import Trees, fit_leaves
from .durable import cut, dealt
from .network import Network, fit_network, settings_of
from .windows import flattened, persistence


def source_features(targets: Sequence[str], encoder: Sequence[str]) -> list[str]:
    """M8: the encoder column that a target persists from: obs_x, then the target itself, then x."""
    out = []
    for t in targets:
        base = t.removeprefix("target_")
        found = next((c for c in (f"obs_{base}", t, base) if c in encoder), None)
        if found is None:
            raise ValueError(f"no encoder column to persist {t} from")
        out.append(found)
    return out


@dataclass(frozen=True)
class Persistence:
    places: tuple[int, ...]
    period: int | None = None

    def predict(self, windows: DataFrame) -> DataFrame:
        return persistence(windows, self.places, self.period)


@dataclass(frozen=True)
class Ridge:
    """Coefficients, features x outputs, and intercepts; an output is a step and target, step first."""

    weights: np.ndarray
    bias: np.ndarray
    horizon: int

    def predict(self, windows: DataFrame) -> DataFrame:
        """Adds `predicted`, horizon x targets."""
        weights, bias, horizon = self.weights, self.bias, self.horizon
        flat = flattened(windows)
        schema = T.StructType([*windows.schema.fields, T.StructField("predicted", T.ArrayType(T.ArrayType(T.DoubleType())))])
        names = windows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.asarray(b.column(len(names)).flatten()).reshape(b.num_rows, -1)
                y = (x @ weights + bias).reshape(b.num_rows, horizon, -1) if b.num_rows else np.zeros((0, horizon, 1))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(y.tolist(), pa.list_(pa.list_(pa.float64())))], names=[*names, "predicted"])

        return flat.select(*names, "features").mapInArrow(run, schema)

    def importance(self, names: Sequence[str], targets: Sequence[str]) -> list[tuple]:
        """(target, horizon_step, feature, coefficient, importance), by target, step, and falling importance."""
        rows = []
        for h in range(self.horizon):
            for j, t in enumerate(targets):
                c = self.weights[:, h * len(targets) + j]
                rows += [(t, h + 1, n, float(v), abs(float(v))) for n, v in zip(names, c, strict=True)]
        return sorted(rows, key=lambda r: (r[0], r[1], -r[4], r[2]))

    def dumped(self) -> str:
        """The model as JSON; `loaded` takes it back."""
        return json.dumps({"weights": self.weights.tolist(), "bias": self.bias.tolist(), "horizon": self.horizon})

    @classmethod
    def loaded(cls, text: str) -> Ridge:
        d = json.loads(text)
        return cls(np.array(d["weights"]), np.array(d["bias"]), d["horizon"])


#: Values of a tile: sums travel, and are added, in tiles.
TILE = 8192
#: Columns of a block of the normal equations, and bytes of them that a task holds in one pass over the windows.
BLOCK, HELD = 256, 32 << 20
#: Bytes of normal equations that are solved on the driver. Wider ones stay where they are and are solved by products with them.
SOLVED = 16 << 20


def fit_ridge(windows: DataFrame, alpha: float = 1.0) -> Ridge:
    """M3: (X'X + alpha I) w = X'y with the intercept left free.

    The normal equations are summed block by block of columns, in as many passes as keep a task's blocks under HELD;
    partitions send their sums, never their rows. Equations of more than SOLVED bytes are never gathered: conjugate
    gradients multiply them, where they are stored, with one vector an output, and the driver holds some vectors.
    """
    flat = flattened(windows).select("features", F.flatten("target").alias("y"), F.size("target").alias("h")).persist()
    try:
        shape = flat.select(F.size("features").alias("n"), F.size("y").alias("m"), "h").first()
        if shape is None:
            raise ValueError("no training windows")
        n, m = shape.n + 1, shape.m
        blocks = normal_blocks(flat, n, m)
        if n * (n + m) * 8 <= SOLVED:
            total = gathered(blocks, n, m)
            pull = alpha * np.eye(n)
            pull[-1, -1] = 0.0
            got = np.linalg.lstsq(total[:, :n] + pull, total[:, n:], rcond=None)[0]
        else:
            got = solved(cut(blocks), n, m, alpha)
        return Ridge(got[:-1], got[-1], shape.h)
    finally:
        flat.unpersist()


def normal_blocks(flat: DataFrame, n: int, m: int) -> DataFrame:
    """(i, j, r, part): rows r and on of the product of column blocks i and j of [X 1 y], i up to j, i not beyond [X 1]."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    starts = [*range(0, n, BLOCK), *range(n, n + m, BLOCK)]
    ends = [*(min(s + BLOCK, n) for s in range(0, n, BLOCK)), *(min(s + BLOCK, n + m) for s in range(n, n + m, BLOCK))]
    pairs = [(i, j) for i, s in enumerate(starts) if s < n for j in range(i, len(starts))]
    at_once = max(1, HELD // (8 * min(BLOCK, n + m) ** 2))
    out = None
    for k in range(0, len(pairs), at_once):

        def run(batches: Iterator[pa.RecordBatch], wanted: list = pairs[k : k + at_once]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                if b.num_rows:
                    x, y = (np.asarray(b.column(c).flatten()).reshape(b.num_rows, -1) for c in (0, 1))
                    z = np.column_stack([x, np.ones(b.num_rows), y])
                    for i, j in wanted:
                        part = z[:, starts[i] : ends[i]].T @ z[:, starts[j] : ends[j]]
                        held[i, j] = held[i, j] + part if (i, j) in held else part
            for (i, j), part in held.items():
                step = max(1, TILE // part.shape[1])
                for r in range(0, len(part), step):
                    row = [i, j, r, part[r : r + step].ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [*[pa.int32()] * 3, pa.list_(pa.float64())], strict=True)], names=["i", "j", "r", "part"])

        sums = flat.select("features", "y").mapInArrow(run, "i int, j int, r int, part array<double>")
        sums = sums.groupBy("i", "j", "r").agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("part"))
        out = sums if out is None else out.unionByName(sums)
    return out


def column_of(block: int, n: int, width: int) -> int:
    """The first column of a block: those of [X 1] come first, those of y start anew."""
    of_x = -(-n // width)
    return block * width if block < of_x else n + (block - of_x) * width


def gathered(blocks: DataFrame, n: int, m: int) -> np.ndarray:
    """The whole of [X 1]' [X 1 y] on the driver."""
    total = np.zeros((n, n + m))
    for b in blocks.toLocalIterator():
        a, c = column_of(b.i, n, BLOCK) + b.r, column_of(b.j, n, BLOCK)
        wide = min(BLOCK, (n if c < n else n + m) - c)
        part = np.asarray(b.part).reshape(-1, wide)
        total[a : a + len(part), c : c + wide] = part
        if c < n:
            total[c : c + wide, a : a + len(part)] = part.T
    return total


def products(blocks: DataFrame, n: int, m: int, by: np.ndarray | None) -> np.ndarray:
    """The equations times `by` (n x m), block by block in tasks; without `by`, the diagonal and X'y beside each other."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    shared = blocks.sparkSession.sparkContext.broadcast(by)
    size, width = (n, m if by is not None else 1 + m), BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, out = shared.value, None
        for b in batches:
            for i, j, r, part in zip(*(b.column(c) for c in range(4)), strict=True):
                out = np.zeros(size) if out is None else out
                a, c = column_of(i.as_py(), n, width) + r.as_py(), column_of(j.as_py(), n, width)
                wide = min(width, (n if c < n else n + m) - c)
                part = np.asarray(part.values).reshape(-1, wide)
                if v is None and c >= n:
                    out[a : a + len(part), 1 + c - n : 1 + c - n + wide] += part
                elif v is None and i.as_py() == j.as_py():
                    out[a : a + len(part), 0] += np.diagonal(part, a - c)
                elif v is not None and c < n:
                    out[a : a + len(part)] += part @ v[c : c + wide]
                    if i.as_py() != j.as_py():
                        out[c : c + wide] += part.T @ v[a : a + len(part)]
        if out is not None:
            at = range(0, out.size, TILE)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([out.ravel()[k : k + TILE] for k in at], pa.list_(pa.float64()))], names=["tile", "part"])

    sums = blocks.mapInArrow(run, "tile long, part array<double>").groupBy("tile").agg(Summarizer.sum(array_to_vector("part")).alias("part"))
    out = np.concatenate([r.part.toArray() for r in sums.orderBy("tile").collect()]).reshape(size)
    shared.unpersist()
    return out


def solved(blocks: DataFrame, n: int, m: int, alpha: float, close: float = 1e-13) -> np.ndarray:
    """Conjugate gradients, all outputs in step, scaled by the diagonal; until what is left is `close` to nothing or grows no less."""
    both = products(blocks, n, m, None)
    pull = np.full((n, 1), alpha)
    pull[-1] = 0.0
    scale = np.maximum(both[:, :1] + pull, 1e-300)
    left = both[:, 1:].copy()
    most = np.maximum(np.linalg.norm(left, axis=0), 1e-300)
    x, best, best_left, stale = np.zeros((n, m)), None, np.inf, 0
    z = left / scale
    way, size = z, (left * z).sum(0)
    for _ in range(20 * n):
        worst = (np.linalg.norm(left, axis=0) / most).max()
        best, best_left, stale = (x, worst, 0) if worst < best_left else (best, best_left, stale + 1)
        if worst <= close or stale > 50:
            break
        q = products(blocks, n, m, way) + pull * way
        along = (way * q).sum(0)
        step = np.where(along > 0, size / np.where(along > 0, along, 1.0), 0.0)
        x, left = x + step * way, left - step * q
        z = left / scale
        before, size = size, (left * z).sum(0)
        way = z + np.where(before > 0, size / np.where(before > 0, before, 1.0), 0.0) * way
    return best if best is not None else x


@dataclass(frozen=True)
class Boosted:
    """M4: gradient-boosted trees, one model an output; the nearest native model to the named library, not bit-equal."""

    models: list
    horizon: int

    def predict(self, windows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        names = windows.columns
        df = flattened(windows).withColumn("features", array_to_vector("features"))
        for i, m in enumerate(self.models):
            df = m.setPredictionCol(f"__p{i}").transform(df)
        n = len(self.models) // self.horizon
        return df.select(*names, F.array(*[F.array(*[F.col(f"__p{h * n + j}") for j in range(n)]) for h in range(self.horizon)]).alias("predicted"))

    def importance(self, names: Sequence[str], targets: Sequence[str]) -> list[tuple]:
        rows = []
        for i, m in enumerate(self.models):
            rows += [(targets[i % len(targets)], i // len(targets) + 1, n, None, float(v)) for n, v in zip(names, m.featureImportances.toArray(), strict=True)]
        return sorted(rows, key=lambda r: (r[0], r[1], -r[4], r[2]))


def fit_boosted(windows: DataFrame, trees: int = 100, depth: int = 4, rate: float = 0.05, seed: int = 42) -> Boosted:
    """One model a step and target; trees of depth 4 have up to 16 leaves, the nearest to the 15 that the setting names."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    rows = flattened(windows).select(array_to_vector("features").alias("features"), F.flatten("target").alias("y"), F.size("target").alias("h"), F.size("features").alias("n"))
    head = rows.select(F.size("y"), "h", "n").first()
    if head is None:
        raise ValueError("no training windows")
    df = dealt(rows, head[2])
    models = [GBTRegressor(labelCol="label", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed).fit(df.select("features", F.col("y")[i].alias("label"))) for i in range(head[0])]
    return Boosted(models, head[1])


#: M7: model type -> how it is made from training windows, settings and column names.
REGISTRY: dict[str, Callable] = {
    "persistence": lambda windows, encoder, targets, **s: Persistence(tuple(list(encoder).index(c) for c in source_features(targets, encoder))),
    "seasonal_persistence": lambda windows, encoder, targets, **s: Persistence(tuple(list(encoder).index(c) for c in source_features(targets, encoder)), int(s.get("seasonal_period", 24))),
    "ridge": lambda windows, encoder, targets, **s: fit_ridge(windows, float(s.get("alpha", 1.0))),
    "boosted_trees": lambda windows, encoder, targets, **s: fit_boosted(windows, int(s.get("trees", 100)), int(s.get("depth", 4)), float(s.get("rate", 0.05))),
    "boosted_leaves": lambda windows, encoder, targets, **s: fit_leaves(windows, **leaf_settings(s), start=s.get("start")),
    "network": lambda windows, encoder, targets, **s: fit_network(windows, s.get("validation"), **settings_of(s), start=s.get("start")),
}
#: Fixed: names that configs give the boosted trees and the neural model, and backends of the latter.
ALIASES = {"lightgbm": "boosted_leaves", "tft": "network"}
BACKENDS = {"auto", "pytorch_forecasting", "fallback_torch"}
#: Fixed: names that configs give settings of the boosted trees, and what they mean here.
LEAF_SETTINGS = {"n_estimators": "trees", "num_leaves": "leaves", "learning_rate": "rate", "max_bin": "bins", "min_child_samples": "least_rows", "reg_lambda": "penalty", "min_split_gain": "least_gain"}


def leaf_settings(settings: dict) -> dict:
    """The keywords of `fit_leaves` among a model's settings, by either name; those under `params` count as well."""
    kinds = {"trees": int, "leaves": int, "rate": float, "bins": int, "least_rows": int, "penalty": float, "least_gain": float}
    named = {LEAF_SETTINGS.get(k, k): v for k, v in {**settings, **settings.get("params", {})}.items()}
    return {k: kind(named[k]) for k, kind in kinds.items() if k in named} | ({"edges": settings["edges"]} if "edges" in settings else {})


def resolved(kind: str, settings: dict) -> dict:
    """M7: settings with the model type and backend that will run, and what was asked for.

    The neural model's large backend is not built here, so `auto` is the network, and so is a request for the large one that
    allows a fallback (asked for or by `auto`); without leave it is an error.
    """
    if kind != "tft":
        return {**settings, "type": ALIASES.get(kind, kind)}
    asked = settings.get("backend", "auto")
    if asked not in BACKENDS:
        raise ValueError(f"unknown backend {asked!r}; known: {sorted(BACKENDS)}")
    if asked == "pytorch_forecasting" and not settings.get("allow_fallback_backend", False):
        raise RuntimeError("the backend pytorch_forecasting was asked for and is not there; allow_fallback_backend would take the network")
    return {**settings, "type": "network", "requested_backend": asked, "backend": "fallback_torch"} | ({"hidden": settings["hidden_size"]} if "hidden_size" in settings else {}) | ({"rate": settings["dropout"]} if "dropout" in settings else {})


def make(kind: str, windows: DataFrame, encoder: Sequence[str], targets: Sequence[str], **settings: object):  # noqa: ANN201
    """The model of a type. `start` is a saved model of the type to go on from (M9); `validation` is windows that stop a network early."""
    if kind not in REGISTRY and kind not in ALIASES:
        raise ValueError(f"unknown model type {kind!r}; known: {sorted([*REGISTRY, *ALIASES])}")
    settings = resolved(kind, settings)
    return REGISTRY[settings.pop("type")](windows, encoder, targets, **settings)


#: Models that are saved as one JSON text.
SAVED = {"ridge": Ridge, "boosted_leaves": Trees, "network": Network}


def save(model: object, spark: SparkSession, place: str) -> str:
    """Writes the model under `place` on the session's file system, replacing what was there.

    Ridge, leaf trees and networks are one JSON text, persistence its places; Spark's own trees are saved by Spark.
    """
    kind = next((k for k, c in SAVED.items() if isinstance(model, c)), None)
    if kind:
        text = model.dumped()
    elif isinstance(model, Persistence):
        kind, text = "persistence", json.dumps({"places": model.places, "period": model.period})
    else:
        kind, text = "boosted_trees", json.dumps({"horizon": model.horizon, "outputs": len(model.models)})
        for i, m in enumerate(model.models):
            m.write().overwrite().save(f"{place}/output-{i}")
    spark.createDataFrame([(kind, text)], "kind string, model string").coalesce(1).write.mode("overwrite").json(f"{place}/model")
    return place


def load(spark: SparkSession, place: str):  # noqa: ANN201
    """What `save` wrote."""
    row = spark.read.schema("kind string, model string").json(f"{place}/model").first()
    if row.kind in SAVED:
        return SAVED[row.kind].loaded(row.model)
    d = json.loads(row.model)
    if row.kind == "persistence":
        return Persistence(tuple(d["places"]), d["period"])
    from pyspark.ml.regression import GBTRegressionModel

    return Boosted([GBTRegressionModel.load(f"{place}/output-{i}") for i in range(d["outputs"])], d["horizon"])
