"""Time: alignment to UTC, parts, seasons, splits, hours between."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_utc(c: Column, kind: T.DataType, source_tz: str) -> Column:
    """A UTC timestamp. Text with an offset is absolute; text without, and zoneless timestamps, are of `source_tz`."""
    if isinstance(kind, T.TimestampType):
        return c
    if isinstance(kind, T.TimestampNTZType):
        return F.to_utc_timestamp(c.cast("timestamp"), source_tz)
    text = F.trim(c.cast("string"))
    absolute = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.rlike(":")
    at = F.try_to_timestamp(text)
    return F.when(absolute, at).otherwise(F.to_utc_timestamp(at, source_tz))


def align(df: DataFrame, source_tz: str = "Asia/Seoul", column: str = "datetime") -> DataFrame:
    return df.withColumn(column, to_utc(df[column], df.schema[column].dataType, source_tz))


def to_local(df: DataFrame, tz: str = "Asia/Seoul", column: str = "datetime", out: str = "datetime_local") -> DataFrame:
    return df.withColumn(out, F.from_utc_timestamp(column, tz))


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring").when(month.isin(6, 7, 8), "summer").otherwise("autumn")


def with_time_features(df: DataFrame, column: str = "datetime") -> DataFrame:
    """D3: hour, dayofyear, month, their sines and cosines, season; all of the UTC time."""
    t = F.col(column)
    hour, day, month = F.hour(t), F.dayofyear(t), F.month(t)
    turn = 2 * math.pi
    return df.withColumns(
        {
            "hour": hour, "dayofyear": day, "month": month,
            "hour_sin": F.sin(turn * hour / 24), "hour_cos": F.cos(turn * hour / 24),
            "dayofyear_sin": F.sin(turn * day / 366), "dayofyear_cos": F.cos(turn * day / 366),
            "month_sin": F.sin(turn * month / 12), "month_cos": F.cos(turn * month / 12),
            "season": season(month),
        }
    )


def split_label(t: Column, train_end: str, val_end: str, test_end: str) -> Column:
    """train, val, test up to the three ends, each included; later, and without a time, holdout."""
    return F.when(t <= F.lit(train_end).cast("timestamp"), "train").when(t <= F.lit(val_end).cast("timestamp"), "val").when(t <= F.lit(test_end).cast("timestamp"), "test").otherwise("holdout")


def with_split(df: DataFrame, ends: dict, column: str = "datetime") -> DataFrame:
    return df.withColumn("split", split_label(F.col(column).cast("timestamp"), ends["train_end"], ends["val_end"], ends["test_end"]))


def hours_between(a: Column, b: Column) -> Column:
    """Hours from a to b, as a double."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(3.6e9)


def hour_gaps(df: DataFrame, keys: list[str] = ["station_id"], column: str = "datetime") -> DataFrame:  # noqa: B006
    """`gap_hours` to the row before; null for a station's first."""
    w = Window.partitionBy(*keys).orderBy(column)
    return df.withColumn("gap_hours", hours_between(F.lag(column).over(w), F.col(column)))


def is_hourly(df: DataFrame, keys: list[str] = ["station_id"], column: str = "datetime") -> DataFrame:  # noqa: B006
    """One row a station: whether each of its rows is one hour after the row before."""
    return hour_gaps(df, keys, column).groupBy(*keys).agg(F.coalesce(F.bool_and(F.col("gap_hours") == 1), F.lit(True)).alias("hourly"))
