"""A4: time buckets."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.schema import STANDARD_COLUMNS

#: Fixed: how each measure is aggregated unless told otherwise.
DEFAULT_AGGREGATION = {"temp": "mean", "humidity": "mean", "pressure": "mean", "wind_speed": "mean", "precipitation": "sum", "quality_flag": "last"}
UNITS = {"s": 1, "sec": 1, "min": 60, "t": 60, "h": 3600, "hour": 3600, "d": 86400, "day": 86400}


def seconds_of(rule: str) -> int:
    """Length of a bucket rule such as 1h, 30min or D; it must divide a day, as buckets are anchored at midnight."""
    m = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", rule)
    unit = m and UNITS.get(m[2].lower())
    n = int(m[1] or 1) * unit if unit else 0
    if not n or 86400 % n:
        raise ValueError(f"bucket rule {rule!r} does not divide a day")
    return n


def bucket_start(t: Column, seconds: int) -> Column:
    """Start of the bucket of a timestamp (UTC)."""
    at = F.unix_micros(t.cast("timestamp"))
    return F.timestamp_micros(at - F.pmod(at, F.lit(seconds * 1_000_000)))


def aggregated(name: str, how: str, order: Column) -> Column:
    c = F.col(name)
    there = F.when(c.isNotNull(), F.struct(order, c.alias("v")))
    made = {
        "mean": lambda: F.avg(c), "sum": lambda: F.coalesce(F.sum(c), F.lit(0.0)), "min": lambda: F.min(c), "max": lambda: F.max(c),
        "count": lambda: F.count(c), "median": lambda: F.median(c), "std": lambda: F.stddev_samp(c),
        "last": lambda: F.max(there)["v"], "first": lambda: F.min(there)["v"],
    }
    if how not in made:
        raise ValueError(f"unknown aggregation {how!r}")
    return made[how]().alias(name)


def resample(df: DataFrame, rule: str, aggregation: Mapping[str, str] | None = None) -> DataFrame:
    """One row a station and bucket. Buckets without any temperature go; a sum of nothing is 0.

    A plain aggregate, so partial sums are made before the exchange however many rows a station has.
    """
    how = {c: (aggregation or {}).get(c, DEFAULT_AGGREGATION.get(c, "last")) for c in STANDARD_COLUMNS[2:]}
    at = F.col("datetime").alias("t")
    out = df.groupBy("station_id", bucket_start(F.col("datetime"), seconds_of(rule)).alias("bucket")).agg(*[aggregated(c, h, at) for c, h in how.items()])
    return out.where("temp is not null").withColumnRenamed("bucket", "datetime").select(STANDARD_COLUMNS)
