"""Windows of training, validation and test rows, and long tables of what was predicted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.functions.timefns import season
from skylattice.operators import encode, scaling
from skylattice.operators.spatial import first_per
from skylattice.operators.windows import sliding, varying, with_hour_index, with_row_index


@dataclass(frozen=True)
class Bundle:
    windows: DataFrame
    rows: DataFrame
    scaler: scaling.Scaler | None
    encoder: tuple[str, ...]
    decoder: tuple[str, ...]
    static: tuple[str, ...]
    targets: tuple[str, ...]
    encoder_length: int
    horizon: int

    def part(self, split: str) -> DataFrame:
        """P14."""
        return self.windows.where(F.col("split") == split)


def bundle_v1(table: DataFrame, features: Mapping, targets: Sequence[str], window: Mapping) -> Bundle:
    """One scaler over training rows, windows within a split, gaps and nulls let through."""
    encoder, decoder, static = features["encoder_continuous"], features["decoder_known"], features.get("static_real", [])
    scaled = list(dict.fromkeys([*encoder, *decoder, *static, *targets]))
    scaler = scaling.fit(table.where("split = 'train'"), scaled)
    rows = scaling.transform(with_row_index(table), scaler)
    windows = sliding(rows, encoder, decoder, static, targets, window["encoder_length"], window["prediction_length"], contiguous=False)
    return Bundle(windows, rows, scaler, tuple(encoder), tuple(decoder), tuple(static), tuple(targets), window["encoder_length"], window["prediction_length"])


def bundle_v2(table: DataFrame, features: Mapping, window: Mapping, mode: str = "global", scaled: Sequence[str] | None = None) -> Bundle:
    """Scaled by the mode, categories one-hot by training levels, rows with nulls dropped, windows hour by hour."""
    encoder, decoder = features["encoder_continuous"], features["decoder_known"]
    real, categories = features.get("static_real", []), features.get("static_categorical", [])
    targets = ["target_value"]
    indexed = with_hour_index(table)
    train = indexed.where("split = 'train'")
    scaler = scaling.fit(train, list(scaled or dict.fromkeys([*encoder, *decoder, *real, *targets])), mode)
    rows = scaling.transform(indexed, scaler)
    found = encode.levels(train, categories)
    rows = encode.one_hot(rows, found)
    static = [*real, *(f"static_cat__{c}__{v}" for c, vs in found.items() for v in vs)]
    rows = encode.complete(rows, list(dict.fromkeys([*encoder, *decoder, *static, *targets])))
    windows = sliding(rows, encoder, decoder, static, targets, window["encoder_length"], window["prediction_length"])
    return Bundle(windows, rows, scaler, tuple(encoder), tuple(decoder), tuple(static), tuple(targets), window["encoder_length"], window["prediction_length"])


#: Fixed: splits in the order of their times.
SPLITS = ("train", "val", "test")


def split_windows(bundle: Bundle, split: str, shortest: int | None = None, last_only: bool = False) -> DataFrame:
    """Windows of one split whose encoders, `shortest` rows or more, may reach into the splits before it; rows need time_idx."""
    seen = bundle.rows.where(F.col("split").isin(*SPLITS[: SPLITS.index(split) + 1]))
    first = bundle.rows.where(F.col("split") == split).agg(F.min("time_idx")).first()[0]
    made = varying(seen, bundle.encoder, bundle.decoder, bundle.static, bundle.targets, bundle.encoder_length, bundle.horizon, shortest, first, last_only)
    return made.where(F.col("split") == split)


def prediction_frame(predicted: DataFrame, targets: Sequence[str], scaler: scaling.Scaler | None, stations: DataFrame) -> DataFrame:
    """One row a window, step and target, in the target's own units.

    station_id, prediction_start, valid_time, horizon_step, target_name, prediction, actual, region_class,
    region, season of the valid time. `stations` may repeat a station; its first row counts (J8).
    """
    names = F.array(*[F.lit(t) for t in targets])
    long = predicted.select("station_id", "split", "prediction_start", F.posexplode(F.arrays_zip("predicted", "target")).alias("step", "v"))
    long = long.select("station_id", "split", "prediction_start", (F.col("step") + 1).alias("horizon_step"), F.posexplode(F.arrays_zip(F.col("v.predicted").alias("p"), F.col("v.target").alias("y"), names.alias("t"))).alias("no", "x"))
    long = long.select("station_id", "split", "prediction_start", "horizon_step", F.col("x.t").alias("target"), F.col("x.p").alias("prediction"), F.col("x.y").alias("actual"))
    if scaler is not None:
        parts = [scaling.inverse(long.where(F.col("target") == t), scaler, {"prediction": t, "actual": t}) for t in targets] if len(targets) > 1 else [scaling.inverse(long, scaler, {"prediction": targets[0], "actual": targets[0]})]
        long = parts[0]
        for p in parts[1:]:
            long = long.unionByName(p)
    valid = F.timestamp_micros(F.unix_micros(F.col("prediction_start").cast("timestamp")) + (F.col("horizon_step") - 1) * F.lit(3_600_000_000))
    attributes = [c for c in ("region_class", "region") if c in stations.columns]
    one = first_per(stations, ["station_id"], [F.col(c) for c in attributes] or [F.lit(0)]).select("station_id", *attributes)
    long = long.withColumn("valid_time", valid).join(one, "station_id", "left")
    return long.withColumns({"season": season(F.month("valid_time")), "target_name": F.regexp_replace("target", "^target_", "")}).drop("target")
