"""Errors of forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ["rmse", "mae", "bias", "mape"]
SETS_V1 = [["station_id"], ["region"], ["season"], ["horizon_step"]]
SETS_V2 = [["target_name"], ["target_name", "horizon_step"], ["target_name", "station_id"], ["target_name", "region"], ["target_name", "season"]]


def error_columns(prediction: str = "prediction", actual: str = "actual", strict: bool = False) -> list[Column]:
    """rmse, mae, bias = mean(prediction - actual), and mape over actuals of at least a millionth.

    Pairs with a null are passed over; with `strict` one such pair makes every metric but mape NaN.
    """
    e = F.col(prediction) - F.col(actual)
    out = [F.sqrt(F.avg(e * e)), F.avg(F.abs(e)), F.avg(e)]
    if strict:
        out = [F.when(F.count_if(e.isNull()) > 0, F.lit(float("nan"))).otherwise(c) for c in out]
    y = F.abs(F.col(actual))
    out.append(100.0 * F.avg(F.when(y >= 1e-6, F.abs(e) / y)))
    return [c.alias(n) for c, n in zip(out, METRICS, strict=True)]


def metrics(df: DataFrame, **how: object) -> DataFrame:
    return df.agg(*error_columns(**how), F.count("*").alias("count"))


def grouped_metrics(df: DataFrame, keys: Sequence[str], **how: object) -> DataFrame:
    """A2: by keys; rows with a null key are passed over."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(*error_columns(**how), F.count("*").alias("count"))


def macro_metrics(df: DataFrame, target: str = "target_name") -> DataFrame:
    """A5: for several targets the mean of each target's metrics, for one its own."""
    return grouped_metrics(df, [target]).agg(*[F.avg(m).alias(m) for m in METRICS], F.sum("count").alias("count"))


def breakdowns(df: DataFrame, sets: Sequence[Sequence[str]] = SETS_V2, **how: object) -> DataFrame:
    """Metrics of every set of keys from one scan; `breakdown` names the set, keys outside it are null."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    cols = [F.col(k) for k in keys]
    out = df.groupingSets([[F.col(k) for k in s] for s in sets], *cols).agg(
        *error_columns(**how), F.count("*").alias("count"), F.grouping_id(*cols).alias("__g"), *[F.grouping(k).alias(f"__{k}") for k in keys]
    )
    for k in keys:
        out = out.where((F.col(f"__{k}") == 1) | F.col(k).isNotNull())
    name = F.concat_ws("+", *[F.when(F.col(f"__{k}") == 0, k) for k in keys])
    return out.select(name.alias("breakdown"), *keys, *METRICS, "count")


def breakdown_sets_v1(several_targets: bool) -> list[list[str]]:
    return SETS_V1 + ([["target_name"], *(["target_name", *s] for s in SETS_V1)] if several_targets else [])


def with_folds(df: DataFrame, k: int = 3, at: str = "prediction_start") -> DataFrame:
    """`fold` of each forecast origin: at most k runs of origins, of equal size or one more; none if there is one origin."""
    origins = df.select(at).distinct()
    n = origins.count()
    if n <= 1:
        return df.withColumn("fold", F.lit(None).cast("int"))
    # Origins are distinct times: a row an hour, however many stations and steps there are.
    numbered = origins.withColumn("fold", F.ntile(min(k, n)).over(Window.orderBy(at)))
    return df.join(numbered, at)


def fold_metrics(df: DataFrame, k: int = 3) -> DataFrame:
    return grouped_metrics(with_folds(df, k), ["fold"])


def horizon_summary(df: DataFrame) -> DataFrame:
    """A16, J7."""
    return df.groupBy("horizon_step").agg(F.avg("actual").alias("mean_actual"), F.avg("prediction").alias("mean_prediction"), F.avg(F.abs(F.col("prediction") - F.col("actual"))).alias("mae"))


def mse(df: DataFrame) -> DataFrame:
    """A17."""
    return df.agg(F.avg(F.pow(F.col("prediction") - F.col("actual"), 2)).alias("mse"))


def worst_cases(df: DataFrame, n: int = 100, keys: Sequence[str] = ("station_id", "prediction_start", "horizon_step", "target_name")) -> DataFrame:
    """L2: the n greatest absolute errors; ties by keys."""
    e = F.abs(F.col("prediction") - F.col("actual"))
    return df.withColumn("abs_error", e).orderBy(F.col("abs_error").desc_nulls_last(), *[k for k in keys if k in df.columns]).limit(n)


BIAS_KEYS = {"global": [], "per_horizon": ["horizon_step"], "per_station_horizon": ["station_id", "horizon_step"]}


def fit_bias(validation: DataFrame, mode: str = "per_horizon") -> DataFrame:
    """Mean error by the mode's keys."""
    if mode not in BIAS_KEYS:
        raise ValueError(f"unknown bias mode {mode!r}")
    return validation.groupBy(*BIAS_KEYS[mode]).agg(F.avg(F.col("prediction") - F.col("actual")).alias("bias_value"))


def postprocess(df: DataFrame, bias: DataFrame | None, mode: str = "per_horizon", low: float | None = None, high: float | None = None) -> DataFrame:
    """prediction_raw, then prediction less its bias (0 where there is none) within bounds."""
    from skylattice.functions.physics import clipped

    df = df.withColumn("prediction_raw", F.col("prediction"))
    if bias is not None:
        keys = BIAS_KEYS[mode]
        df = df.join(bias, keys, "left") if keys else df.join(F.broadcast(bias), F.lit(True), "left")
        df = df.withColumn("prediction", F.col("prediction") - F.coalesce("bias_value", F.lit(0.0))).drop("bias_value")
    return df.withColumn("prediction", clipped(F.col("prediction"), low, high))


def verification_frame(df: DataFrame) -> DataFrame:
    """K6: station_id, init_time, valid_time, prediction, actual, and the other key columns that are there."""
    more = [c for c in ("horizon_step", "target_name", "region", "season") if c in df.columns]
    return df.select("station_id", F.col("prediction_start").cast("timestamp").alias("init_time"), F.col("valid_time").cast("timestamp").alias("valid_time"), "prediction", "actual", *more)
