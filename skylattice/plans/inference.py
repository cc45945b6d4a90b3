"""A forecast from the rows up to one time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.timefns import hours_between, with_time_features
from skylattice.operators.metrics import postprocess
from skylattice.operators.spatial import everywhere

from .bundle import Bundle, prediction_frame


def history(rows: DataFrame, init: str, length: int, station: str | None = None) -> DataFrame:
    """The last `length` rows of each station, or of one, up to the time `init`."""
    df = rows.where(F.col("datetime") <= F.lit(init).cast("timestamp"))
    if station is not None:
        df = df.where(F.col("station_id") == station)
        return df.orderBy(F.col("datetime").desc()).limit(length)
    w = Window.partitionBy("station_id").orderBy(F.col("datetime").desc())
    return df.withColumn("__no", F.row_number().over(w)).where(F.col("__no") <= length).drop("__no")


def future_rows(rows: DataFrame, init: str, horizon: int) -> DataFrame:
    """I4: for each station its last row up to `init`, carried on for `horizon` hours with their own time features."""
    last = history(rows, init, 1)
    hours = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("__h")
    at = F.timestamp_micros(F.unix_micros(F.lit(init).cast("timestamp")) + F.col("__h") * F.lit(3_600_000_000))
    made = last.select("*", hours).withColumn("datetime", at).drop("__h")
    fresh = with_time_features(made)
    return fresh.select(*rows.columns)


def latest_rows(rows: DataFrame, inits: DataFrame, length: int) -> DataFrame:
    """P16 for many times at once: `init` and the last `length` rows of each station up to each `init` (a timestamp).

    Rows and times are merged once in each station: the last row before a time is known by its number, and the rows before
    that one follow by number. Work grows with the rows and with what is returned, not with rows times times.
    """
    own = rows.where(F.col("datetime").isNotNull()).withColumn("__n", F.row_number().over(Window.partitionBy("station_id").orderBy("datetime")))
    asked = everywhere(rows.select("station_id").distinct(), inits.select(F.col("init").cast("timestamp").alias("init")).where("init is not null").distinct(), "init")
    events = own.select("station_id", F.col("datetime").cast("timestamp").alias("t"), F.lit(0).alias("kind"), "__n", F.lit(None).cast("timestamp").alias("init"))
    events = events.unionByName(asked.select("station_id", F.col("init").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("__n"), "init"))
    before = Window.partitionBy("station_id").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = events.withColumn("__last", F.last("__n", ignorenulls=True).over(before)).where("init is not null and __last is not null")
    wanted = last.select("station_id", "init", F.explode(F.sequence(F.greatest(F.col("__last") - (length - 1), F.lit(1)), F.col("__last"))).alias("__n"))
    return own.join(wanted, ["station_id", "__n"]).drop("__n")


def forecast(bundle: Bundle, model, init: str, stations: DataFrame, known: DataFrame | None = None, bias: DataFrame | None = None, mode: str = "per_horizon", limits: tuple[float | None, float | None] = (None, None), tz: str | None = None, strict: bool = True) -> DataFrame:  # noqa: ANN001
    """`forecasts` of one time: station_id, timestamp, target_name, prediction."""
    past = history(bundle.rows, init, bundle.encoder_length).withColumn("init", F.lit(init).cast("timestamp"))
    return _from_past(bundle, model, past, stations, known, bias, mode, limits, tz, strict).drop("init")


def forecasts(bundle: Bundle, model, inits: DataFrame, stations: DataFrame, known: DataFrame | None = None, bias: DataFrame | None = None, mode: str = "per_horizon", limits: tuple[float | None, float | None] = (None, None), tz: str | None = None, strict: bool = True) -> DataFrame:  # noqa: ANN001
    """I1, I2 for many times in one plan: station_id, init, timestamp, target_name, prediction for the hours after each `init` of `inits`.

    The encoder is each station's last rows up to `init`. Decoder values come from `known` (rows by
    station_id and datetime, scaled like the bundle's) and, where it has none, from the last encoder row
    (I3). With `strict`, a station whose encoder rows aren't hour by hour is left out, as no window of
    version 2 would hold them; version 1 lets them pass. Bias and limits apply last; `tz` shifts output times.
    """
    return _from_past(bundle, model, latest_rows(bundle.rows, inits, bundle.encoder_length), stations, known, bias, mode, limits, tz, strict)


def _from_past(bundle: Bundle, model, past: DataFrame, stations: DataFrame, known: DataFrame | None, bias: DataFrame | None, mode: str, limits: tuple[float | None, float | None], tz: str | None, strict: bool) -> DataFrame:  # noqa: ANN001
    """`forecasts` from the encoder's rows of each station and init."""
    keys = ["station_id", "init"]
    hours_on = lambda h: F.timestamp_micros(F.unix_micros("init") + h * F.lit(3_600_000_000))
    w = Window.partitionBy(*keys).orderBy("datetime")
    rows = F.sort_array(F.collect_list(F.struct("datetime", *dict.fromkeys([*bundle.encoder, *bundle.decoder, *bundle.static]))))
    past = past.withColumn("__gap", hours_between(F.lag("datetime").over(w), F.col("datetime")))
    enc = past.groupBy(*keys).agg(rows.alias("r"), F.coalesce(F.bool_and(F.col("__gap") == 1), F.lit(True)).alias("hourly"))
    enc = enc.where(F.size("r") == bundle.encoder_length)
    if strict:
        enc = enc.where("hourly")
    last = F.element_at("r", -1)
    steps = enc.select(*keys, "r", F.explode(F.sequence(F.lit(1), F.lit(bundle.horizon))).alias("h")).withColumn("datetime", hours_on(F.col("h")))
    given: Sequence[str] = []
    if known is not None:
        given = [c for c in bundle.decoder if c in known.columns]
        steps = steps.join(known.select("station_id", "datetime", *[F.col(c).alias(f"__{c}") for c in given]), ["station_id", "datetime"], "left")
    value = [F.coalesce(F.col(f"__{c}"), last[c]) if c in given else last[c] for c in bundle.decoder]
    future = F.sort_array(F.collect_list(F.struct("h", F.array(*[v.cast("double") for v in value]).alias("v"))))
    windows = steps.groupBy(*keys).agg(F.first("r").alias("r"), future.alias("f"))
    nothing = F.transform("f", lambda _: F.array(*[F.lit(None).cast("double") for _ in bundle.targets]))
    windows = windows.select(
        "station_id", F.lit("forecast").alias("split"), hours_on(F.lit(1)).alias("prediction_start"),
        F.transform("r", lambda x: F.array(*[x[c].cast("double") for c in bundle.encoder])).alias("encoder"), F.transform("f", lambda x: x["v"]).alias("decoder"),
        (F.array(*[F.element_at("r", -1)[c].cast("double") for c in bundle.static]) if bundle.static else F.array().cast("array<double>")).alias("static"), nothing.alias("target"),
    )
    long = prediction_frame(model.predict(windows), bundle.targets, bundle.scaler, stations)
    long = postprocess(long, bias, mode, *limits)
    at = F.from_utc_timestamp("valid_time", tz) if tz else F.col("valid_time")
    init = F.timestamp_micros(F.unix_micros("prediction_start") - F.lit(3_600_000_000))
    return long.select("station_id", init.alias("init"), at.alias("timestamp"), "target_name", "prediction")


def settings(config: Mapping) -> dict:
    """Bias mode and limits as a config has them."""
    limits = config["data"].get("postprocess", {})
    bias = config.get("evaluation", {}).get("bias_correction", {})
    return {"mode": bias.get("mode", "per_horizon"), "enabled": bool(bias.get("enabled", False)), "limits": (limits.get("clip_min"), limits.get("clip_max"))}
