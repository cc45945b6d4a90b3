"""M4: gradient boosting with trees grown leaf by leaf, for all outputs of a window at once.

Features are cut into bins once. A pass over the rows sums gradients and counts by leaf, feature and bin; partitions send
their sums, an aggregate adds them, tasks search the best splits, and the driver sees one split a leaf. A leaf's children
are measured before it is known whether it will be split, so that one pass serves all leaves (and outputs) of a level; only
the smaller child is counted, its sibling is the parent less it. Then the best leaf of each tree is split first, until the
tree has its leaves.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .durable import cut, dealt
from .network import complete, matrix
from .windows import flattened

#: Features of a block of histograms, and bytes of histograms that one task may hold in a pass.
BLOCK, HELD = 64, 64 << 20
#: Trees after which the scores are cut from their lineage.
CUT_EVERY = 10
STATE = "bins binary, y array<double>, score array<double>"
SUMS = "output int, node int, block int, part array<double>"


@dataclass(frozen=True)
class Trees:
    """`trees[output]`: each a dict of lists feature, threshold, left, right, value by node; a leaf's feature is -1.

    A row goes left where its feature is at most the threshold. `start` is each output's mean; an output is a step and
    target, step first.
    """

    trees: tuple[tuple[dict, ...], ...]
    start: tuple[float, ...]
    horizon: int

    def predict(self, windows: DataFrame) -> DataFrame:
        """Adds `predicted`, horizon x targets; null for a window with a null feature."""
        names, horizon, outputs = windows.columns, self.horizon, len(self.start)
        schema = T.StructType([*windows.schema.fields, T.StructField("predicted", T.ArrayType(T.ArrayType(T.DoubleType())))])
        shared = windows.sparkSession.sparkContext.broadcast((self.trees, self.start))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, start = shared.value
            for b in batches:
                lists = b.column(len(names))
                x = matrix(lists, len(lists[0])) if b.num_rows else np.zeros((0, 1))
                y = np.repeat(np.array(start)[None, :], len(x), 0)
                for o, own in enumerate(trees):
                    for t in own:
                        y[:, o] += leaf_values(t, x)
                known = ~np.isnan(x).any(1)
                rows = [v if k else None for v, k in zip(y.reshape(len(x), horizon, outputs // horizon).tolist(), known)]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(rows, pa.list_(pa.list_(pa.float64())))], names=[*names, "predicted"])

        return flattened(windows).select(*names, "features").mapInArrow(run, schema)

    def importance(self, names: Sequence[str], targets: Sequence[str]) -> list[tuple]:
        """(target, horizon_step, feature, null, number of splits), by target, step, and falling number."""
        rows = []
        for o, own in enumerate(self.trees):
            used = np.bincount([f for t in own for f in t["feature"] if f >= 0], minlength=len(names))
            rows += [(targets[o % len(targets)], o // len(targets) + 1, n, None, float(v)) for n, v in zip(names, used, strict=True)]
        return sorted(rows, key=lambda r: (r[0], r[1], -r[4], r[2]))

    def dumped(self) -> str:
        """The model as JSON; `loaded` takes it back, and `fit_leaves` goes on from it."""
        return json.dumps({"trees": self.trees, "start": self.start, "horizon": self.horizon})

    @classmethod
    def loaded(cls, text: str) -> Trees:
        d = json.loads(text)
        return cls(tuple(tuple(x) for x in d["trees"]), tuple(d["start"]), d["horizon"])


def leaf_values(tree: dict, x: np.ndarray) -> np.ndarray:
    """The value of the leaf that each row of `x` comes to; nodes stand behind their parents."""
    at = np.zeros(len(x), np.int32)
    for i, f in enumerate(tree["feature"]):
        if f >= 0:
            here = np.flatnonzero(at == i)
            at[here] = np.where(x[here, f] <= tree["threshold"][i], tree["left"][i], tree["right"][i])
    return np.asarray(tree["value"])[at]


class Growing:
    """One output's tree while it grows: nodes with their counts, gradients and best splits; ids rise from parent to child."""

    def __init__(self) -> None:
        self.rows, self.sum, self.split, self.kids, self.known = [0], [0.0], [None], [None], [False]
        self.leaves, self.accepted = [0], set()

    def learn(self, node: int, best: tuple | None) -> None:
        """`best`: gain, feature, bin, rows and gradient on the left; None where nothing may be split."""
        self.split[node], self.known[node] = best, True

    def branch(self, node: int) -> tuple[int, int]:
        """Children of `node` by its best split, yet to be measured."""
        _, _, _, n, g = self.split[node]
        for rows, total in ((n, g), (self.rows[node] - n, self.sum[node] - g)):
            self.rows.append(rows)
            self.sum.append(total)
            self.split.append(None)
            self.kids.append(None)
            self.known.append(False)
        self.kids[node] = (len(self.rows) - 2, len(self.rows) - 1)
        return self.kids[node]

    def advance(self, most: int) -> None:
        """Splits the best leaf as long as what is known allows."""
        while len(self.leaves) < most and all(self.known[i] for i in self.leaves):
            open_ = [i for i in self.leaves if self.split[i]]
            if not open_:
                return
            best = min(open_, key=lambda i: (-self.split[i][0], i))
            if self.kids[best] is None:
                if len(self.leaves) + 1 < most:
                    return
                self.branch(best)  # the last split: nobody asks for its children
            self.leaves.remove(best)
            self.leaves += self.kids[best]
            self.accepted.add(best)

    def wanted(self, most: int) -> list[int]:
        """Leaves whose children are to be measured next: as many of the best as could still be split."""
        room = most - len(self.leaves)
        open_ = sorted((i for i in self.leaves if self.split[i]), key=lambda i: (-self.split[i][0], i))[:room]
        return [i for i in open_ if self.kids[i] is None] if room > 1 else []

    def routes(self) -> list[tuple[int, int, int, int, int]]:
        return [(i, s[1], s[2], *self.kids[i]) for i, s in enumerate(self.split) if self.kids[i]]

    def tree(self, edges: Sequence[np.ndarray], rate: float, penalty: float) -> dict:
        """The accepted nodes, renumbered, parents first."""
        order = [i for i in range(len(self.rows)) if i in self.accepted or i in self.leaves]
        number = {v: k for k, v in enumerate(order)}
        inner = [i in self.accepted for i in order]
        return {
            "feature": [self.split[i][1] if a else -1 for i, a in zip(order, inner)],
            "threshold": [float(edges[self.split[i][1]][self.split[i][2]]) if a else 0.0 for i, a in zip(order, inner)],
            "left": [number[self.kids[i][0]] if a else -1 for i, a in zip(order, inner)],
            "right": [number[self.kids[i][1]] if a else -1 for i, a in zip(order, inner)],
            "value": [0.0 if a else -rate * self.sum[i] / (self.rows[i] + penalty) for i, a in zip(order, inner)],
        }


def borders(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Up to `bins` - 1 borders of each feature by a quantile sketch, in one pass; a value is in the bin of the first border not below it."""
    at = [k / bins for k in range(1, bins)]
    found = rows.select(F.posexplode("features").alias("feature", "v")).groupBy("feature").agg(F.percentile_approx("v", at, 10_000).alias("at")).orderBy("feature").collect()
    return [np.unique(r["at"]) for r in found]


def binned(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """STATE: a byte a feature, the targets, and the scores so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0), len(edges))
                bins = np.column_stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)]).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bins], pa.binary()), b.column(1), b.column(2)], names=["bins", "y", "score"])

    return rows.select("features", "y", "score").mapInArrow(run, STATE)


def unpacked(b: pa.RecordBatch, outputs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins (rows x features), targets and scores (rows x outputs) of a batch of STATE."""
    bins = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1)
    return bins, matrix(b.column(1), outputs), matrix(b.column(2), outputs)


def routed(bins: np.ndarray, routes: Sequence[tuple[int, int, int, int, int]]) -> np.ndarray:
    at = np.zeros(len(bins), np.int32)
    for node, feature, border, left, right in routes:
        here = np.flatnonzero(at == node)
        at[here] = np.where(bins[here, feature] <= border, left, right)
    return at


def counted(state: DataFrame, routes: dict[int, list], nodes: dict[int, list[int]], features: int, bins: int, outputs: int) -> DataFrame:
    """SUMS of the given nodes of each output: gradient, then rows, by feature of the block and bin. A partition sends each once."""
    shared = state.sparkSession.sparkContext.broadcast((routes, nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routes, nodes = shared.value
        size = features * bins
        held: dict[tuple[int, int], np.ndarray] = {}
        base = (np.arange(features) * bins).astype(np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x, y, score = unpacked(b, outputs)
            for o, wanted in nodes.items():
                at = routed(x, routes[o])
                for node in wanted:
                    here = np.flatnonzero(at == node)
                    if len(here):
                        cell = (x[here] + base).ravel()
                        g = np.repeat(score[here, o] - y[here, o], features)
                        part = np.stack([np.bincount(cell, g, size), np.bincount(cell, minlength=size)])
                        held[o, node] = held[o, node] + part if (o, node) in held else part
        for (o, node), part in held.items():
            for k in range(0, features, BLOCK):
                row = [o, node, k // BLOCK, part[:, k * bins : (k + BLOCK) * bins].ravel()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64())))], names=["output", "node", "block", "part"])

    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    parts = state.mapInArrow(run, SUMS)
    return parts.groupBy("output", "node", "block").agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("part"))


def best_splits(sums: DataFrame, bins: int, least_rows: int, penalty: float, least_gain: float = 0.0) -> DataFrame:
    """output, node, gain, feature, bin, n, g (on the left), rows, total: each node's best split, the first feature and bin of equal ones; gain is null where none is allowed or all gain no more than `least_gain`."""
    names = {"output": pa.int32(), "node": pa.int32(), "gain": pa.float64(), "feature": pa.int32(), "bin": pa.int32(), "n": pa.float64(), "g": pa.float64(), "rows": pa.float64(), "total": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for o, node, block, part in zip(*(b.column(c).to_pylist() for c in ("output", "node", "block", "part")), strict=True):
                g, n = np.asarray(part).reshape(2, -1, bins)
                rows, total = n[0].sum(), g[0].sum()
                left_n, left_g = n.cumsum(1)[:, :-1], g.cumsum(1)[:, :-1]
                right_n, right_g = rows - left_n, total - left_g
                allowed = (left_n >= least_rows) & (right_n >= least_rows)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(allowed, left_g**2 / (left_n + penalty) + right_g**2 / (right_n + penalty) - total**2 / (rows + penalty), -np.inf)
                k = int(gain.argmax()) if gain.size else -1
                if k >= 0 and gain.flat[k] > least_gain:
                    out.append((o, node, gain.flat[k], block * BLOCK + k // (bins - 1), k % (bins - 1), left_n.flat[k], left_g.flat[k], rows, total))
                else:
                    out.append((o, node, None, None, None, None, None, rows, total))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), names.values(), strict=True)], names=list(names))

    kinds = {pa.int32(): "int", pa.float64(): "double"}
    found = sums.mapInArrow(run, ", ".join(f"{k} {kinds[v]}" for k, v in names.items()))
    first = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "n", "g", "rows", "total")
    return found.groupBy("output", "node").agg(F.max(first).alias("x")).select("output", "node", "x.gain", (-F.col("x.f")).alias("feature"), (-F.col("x.b")).alias("bin"), "x.n", "x.g", "x.rows", "x.total")


def grow(state: DataFrame, wanted: Sequence[int], features: int, bins: int, outputs: int, leaves: int, least_rows: int, penalty: float, least_gain: float = 0.0) -> dict[int, Growing]:
    """The next tree of each wanted output."""
    trees = {o: Growing() for o in wanted}
    held: list[DataFrame] = []
    measure, pairs = {o: [0] for o in wanted}, []  # pairs: output, parent, counted child, its sibling
    while any(measure.values()):
        sums = counted(state, {o: t.routes() for o, t in trees.items()}, {o: v for o, v in measure.items() if v}, features, bins, outputs)
        if pairs:
            before = held[0]
            for x in held[1:]:
                before = before.unionByName(x)
            kin = F.broadcast(state.sparkSession.createDataFrame(pairs, "output int, parent int, node int, sibling int"))  # at most as many as leaves
            both = sums.join(kin, ["output", "node"]).join(before.select("output", F.col("node").alias("parent"), "block", F.col("part").alias("whole")), ["output", "parent", "block"])
            less = F.zip_with("whole", "part", lambda a, b: a - b)
            each = F.explode(F.array(F.struct("node", "part"), F.struct(F.col("sibling").alias("node"), less.alias("part"))))
            sums = both.select("output", "block", each.alias("x")).select("output", "x.node", "block", "x.part")
        held.append(cut(sums.select("output", "node", "block", "part")))  # short lineage: what hangs on a pass is read again by the next
        for r in best_splits(held[-1], bins, least_rows, penalty, least_gain).collect():
            t = trees[r.output]
            if r.node == 0:
                t.rows[0], t.sum[0] = r.rows, r.total
            t.learn(r.node, None if r.gain is None else (r.gain, r.feature, r.bin, r.n, r.g))
        measure, pairs = {o: [] for o in wanted}, []
        for o, t in trees.items():
            while True:
                t.advance(leaves)
                more = False
                for node in t.wanted(leaves):
                    a, b = t.branch(node)
                    if max(t.rows[a], t.rows[b]) < 2 * least_rows:
                        t.learn(a, None)
                        t.learn(b, None)
                        more = True
                    else:
                        small, other = (a, b) if t.rows[a] <= t.rows[b] else (b, a)
                        measure[o].append(small)
                        pairs.append((o, node, small, other))
                if not more or measure[o]:
                    break
    return trees


def scored(state: DataFrame, trees: dict[int, dict], edges: list[np.ndarray], outputs: int) -> DataFrame:
    """STATE with each row's leaf values added to its scores."""
    places = {o: {**t, "threshold": [int(np.searchsorted(edges[f], v)) if f >= 0 else 0 for f, v in zip(t["feature"], t["threshold"])]} for o, t in trees.items()}
    shared = state.sparkSession.sparkContext.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, _, score = unpacked(b, outputs)
                score = score.copy()
                for o, t in shared.value.items():
                    score[:, o] += leaf_values(t, x)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score.tolist(), pa.list_(pa.float64()))], names=["bins", "y", "score"])

    return state.mapInArrow(run, STATE)


def fit_leaves(
    windows: DataFrame,
    trees: int = 100,
    leaves: int = 15,
    rate: float = 0.05,
    bins: int = 63,
    least_rows: int = 20,
    penalty: float = 0.0,
    least_gain: float = 0.0,
    edges: Sequence[Sequence[float]] | None = None,
    start: Trees | None = None,
) -> Trees:
    """Boosted trees of up to `leaves` leaves, `trees` for each step and target; least squares.

    Windows with a null value are passed over. Features are cut into `bins` bins (at most 256) by quantiles, or at `edges`, a
    list for each feature. `least_rows` is what a leaf must hold, `penalty` what is added to its rows; a split must
    gain more than `least_gain`. Of equal splits the
    first feature and lowest border win. `start` (M9) is a saved model to which trees are added. No subset of rows or
    features is drawn. What one task holds in a pass is bounded by taking outputs in groups.
    """
    rows = complete(windows, 1, 0).select("features", "y", "h")
    states: list[DataFrame] = []  # since the last cut
    try:
        shape = rows.select(F.size("features").alias("n"), F.size("y").alias("m"), "h").first()
        if shape is None:
            raise ValueError("no training windows")
        rows = dealt(rows, shape.n)
        edges = [np.asarray(e, np.float64) for e in edges] if edges is not None else borders(rows, bins)
        bins = max(len(e) for e in edges) + 1
        if bins > 256:
            raise ValueError("at most 256 bins")
        outputs = shape.m
        if start is not None:
            mean, done = list(start.start), [list(x) for x in start.trees]
            if len(mean) != outputs:
                raise ValueError("the saved model has other outputs")
        else:
            means = rows.select(F.posexplode("y").alias("o", "v")).groupBy("o").agg(F.avg("v").alias("v")).orderBy("o").collect()
            mean, done = [r.v for r in means], [[] for _ in range(outputs)]
        if start is None:
            scores = rows.withColumn("score", F.array(*[F.lit(float(v)) for v in mean]))
        else:
            scores = start.predict(windows_of(rows)).withColumn("score", F.flatten("predicted"))
        states.append(binned(scores, edges).persist())
        group = max(1, HELD // (shape.n * bins * 16 * leaves))
        for number in range(trees):
            made = {}
            for k in range(0, outputs, group):
                grown = grow(states[-1], range(k, min(k + group, outputs)), shape.n, bins, outputs, leaves, least_rows, penalty, least_gain)
                made.update({o: t.tree(edges, rate, penalty) for o, t in grown.items()})
            for o, t in made.items():
                done[o].append(t)
            if number + 1 < trees:
                after = scored(states[-1], made, edges, outputs)
                if (number + 1) % CUT_EVERY:
                    states.append(after.persist())
                else:
                    after = cut(after)
                    for x in states:
                        x.unpersist()
                    states = [after]
        return Trees(tuple(map(tuple, done)), tuple(mean), shape.h)
    finally:
        for x in states:
            x.unpersist()


def windows_of(rows: DataFrame) -> DataFrame:
    """Rows of flattened features as windows whose static part they are."""
    none = F.array().cast("array<array<double>>")
    return rows.select(none.alias("encoder"), none.alias("decoder"), F.col("features").alias("static"), "y", "features")
