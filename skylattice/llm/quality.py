"""Quality classifier: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, text_of, written

STATISTICS = (
    "log_bytes", "upper", "digits", "stops", "symbols", "marks", "space", "lines_per_word", "word_length", "distinct_words",
    "top_word", "distinct_pairs", "compressed", "distinct_lines", "words_per_line", "not_ascii",
)
N = len(STATISTICS)
#: Random features, the kernel's width in standard deviations, the ridge, and the calibration grid.
FEATURES, WIDTH, RIDGE, GRID = 192, 3.0, 1e-3, 1_000
CUT = 0.7


def _bytes_in(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


UPPER, DIGITS, STOPS = _bytes_in("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes_in("0123456789"), _bytes_in(".,;:'\"?-()")
SYMBOLS, MARKS, SPACE = _bytes_in("#$%&*+/<=>@[\\]^_`{|}~"), _bytes_in("!"), _bytes_in(" \t\n\r\f\v")


def statistics(text: str | None) -> np.ndarray:
    """The document statistics of a whole text; null and empty texts have all zero."""
    out = np.zeros(N)
    if not text:
        return out
    data = text.encode("utf-8", "surrogatepass")
    seen, n = np.bincount(np.frombuffer(data, np.uint8), minlength=256), len(data)
    words, lines = text.split(), text.split("\n")
    w = max(1, len(words))
    shares = [seen[k].sum() / n for k in (UPPER, DIGITS, STOPS, SYMBOLS, MARKS, SPACE)]
    counts = Counter(words)
    out[:] = (
        math.log1p(n), *shares, len(lines) / w, min(30.0, (n - seen[SPACE].sum()) / w), len(counts) / w,
        max(counts.values(), default=0) / w, len(set(zip(words, words[1:], strict=False))) / w, len(zlib.compress(data, 1)) / (n + 20),
        len(set(lines)) / len(lines), math.log1p(w / len(lines)), seen[128:].sum() / n,
    )
    return out


def with_statistics(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    new = T.StructType([T.StructField("statistics", T.ArrayType(T.DoubleType()))])
    return add_columns(df, column, new, lambda texts: ([statistics(x) for x in texts],), keep)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of rows of statistics, the same on every machine, and a constant."""
    rng = np.random.Generator(np.random.PCG64(2))
    turn = rng.standard_normal((N, FEATURES)) / WIDTH
    phase = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ turn + phase), np.ones((len(x), 1))], axis=1)


def summed(df: DataFrame, columns: list[str], fn, size: int) -> np.ndarray:  # noqa: ANN001
    """The sum over all rows of vectors that `fn` sums within a batch: within partitions, then in a few tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += fn(*(b.column(c) for c in columns))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = df.select(*columns).mapInArrow(add, "part binary")
    n = max(1, math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return np.sum([np.zeros(size), *(np.frombuffer(r.part) for r in parts.repartition(n).mapInArrow(merge, "part binary").collect())], axis=0)


def matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(len(lists), N)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    #: Isotonic fit: raw score -> probability, linear between knots.
    knots: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = fourier(x, self.mean, self.scale) @ self.weights
        return np.interp(raw, self.knots, self.values)


def isotonic(at: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted points with `n` rows summing to `total`: block centres and means."""
    blocks: list[list[float]] = []  # rows, sum of labels, sum of places
    for x, k, y in zip(at, n, total, strict=True):
        blocks.append([k, y, x * k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 2] / b[:, 0], np.clip(b[:, 1] / b[:, 0], 0, 1)


def remainder(doc_id: Column, of: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(of))


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """The model of rows (doc_id, statistics) and labels (doc_id, quality); no other column is read.

    Rows whose crc32(doc_id as text) mod 4 is 2 are held out here already. Labels that repeat an id count
    by their mean, null labels not at all. Only sums leave a partition: moments, then the normal equations
    of two folds, then labels counted on a grid of raw scores, which each fold gets from the other's
    weights. Without any label every score is 0.5.
    """
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("label"))
    train = stats.where(remainder(F.col("doc_id"), 4) != 2).join(known, "doc_id")
    train = train.select("statistics", "label", F.pmod(F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string"))), F.lit(2)).cast("int").alias("fold"))
    train = train.persist()
    try:
        moments = summed(train, ["statistics"], lambda x: np.concatenate([[len(x)], matrix(x).sum(0), (matrix(x) ** 2).sum(0)]), 1 + 2 * N)
        n = moments[0]
        if not n:
            return Model(np.zeros(N), np.ones(N), np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))
        mean = moments[1 : N + 1] / n
        scale = np.sqrt(np.maximum(moments[N + 1 :] / n - mean**2, 0))
        scale = np.where(scale > 1e-9, scale, 1)
        k = FEATURES + 1

        def equations(x: pa.Array, label: pa.Array, fold: pa.Array) -> np.ndarray:
            z, y, f = fourier(matrix(x), mean, scale), np.asarray(label), np.asarray(fold)
            return np.concatenate([np.concatenate([(z[f == i].T @ z[f == i]).ravel(), z[f == i].T @ y[f == i]]) for i in (0, 1)])

        sums = summed(train, ["statistics", "label", "fold"], equations, 2 * k * (k + 1)).reshape(2, k * (k + 1))
        pull = np.diag([*np.full(FEATURES, 1.0), 0.0])

        def solve(s: np.ndarray) -> np.ndarray:
            gram, right = s[: k * k].reshape(k, k), s[k * k :]
            return np.linalg.solve(gram + pull * max(1e-6, RIDGE * gram[-1, -1]) + 1e-9 * np.eye(k), right)

        own, other = solve(sums[0] + sums[1]), [solve(sums[1]), solve(sums[0])]

        def counted(x: pa.Array, label: pa.Array, fold: pa.Array) -> np.ndarray:
            z, y, f = fourier(matrix(x), mean, scale), np.asarray(label), np.asarray(fold)
            raw = np.where(f == 0, z @ other[0], z @ other[1])
            cell = np.clip(np.rint((raw + 1) * GRID), 0, 3 * GRID).astype(int)
            return np.concatenate([np.bincount(cell, minlength=3 * GRID + 1), np.bincount(cell, y, 3 * GRID + 1)])

        rows, total = summed(train, ["statistics", "label", "fold"], counted, 2 * (3 * GRID + 1)).reshape(2, -1)
    finally:
        train.unpersist()
    full = np.flatnonzero(rows)
    knots, values = isotonic(full / GRID - 1, rows[full], total[full])
    return Model(mean, scale, own, knots, values)


SCORES = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def scored(stats: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """score and predicted (1 if score >= CUT) of rows with statistics."""

    def run(lists: list) -> tuple:
        s = model.score(np.array(lists, float).reshape(len(lists), N))
        return s, (s >= CUT).astype(np.int32)

    return add_columns(stats, "statistics", SCORES, run, keep)


def classify(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Statistics come from whole texts in one pass and are kept, a row of 16 numbers a document; the model
    is fitted to them and then scores them. Null and empty texts have the statistics of an empty text and
    get its score. Other columns of either table are ignored; an empty table of documents gives no row.
    """
    stats = with_statistics(docs.select("doc_id", text_col), text_col, ["doc_id"])
    stats = written(stats, "statistics")
    model = fit(stats, labels)
    held = (remainder(F.col("doc_id"), 4) == 2).alias("held_out")
    return scored(stats, model, ["doc_id"]).select("doc_id", held, "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the classifier accepts, all columns as they were; the text is read twice, never dealt."""
    stats = written(with_statistics(docs.select("doc_id", text_col), text_col, ["doc_id"]), "statistics")
    model = fit(stats, labels)

    def run(texts: list) -> tuple:
        s = model.score(np.array([statistics(x) for x in texts]).reshape(len(texts), N))
        return (s >= CUT,)

    marked = docs.withColumn("__text", text_of(docs, text_col))
    new = T.StructType([T.StructField("__good", T.BooleanType())])
    return add_columns(marked, "__text", new, run, docs.columns).where("__good").select(*docs.columns)
