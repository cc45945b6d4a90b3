"""Physical and derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clipped(c: Column, low: float | None, high: float | None) -> Column:
    """C within bounds; null stays null, which least and greatest alone would lose."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def dew_point(temp: Column, humidity: Column) -> Column:
    """Magnus dew point in degrees from a temperature and relative humidity, which is taken within 0.001 and 100."""
    alpha = F.log(clipped(humidity, 1e-3, 100.0) / 100.0) + 17.625 * temp / (243.04 + temp)
    return 243.04 * alpha / (17.625 - alpha)


def with_dew_points(df: DataFrame) -> DataFrame:
    for temp, name in (("temp", "obs"), ("era5_t2m", "era5")):
        if {temp, "humidity"} <= set(df.columns):
            t, point = F.col(temp).cast("double"), dew_point(F.col(temp).cast("double"), F.col("humidity").cast("double"))
            df = df.withColumns({f"{name}_dew_point_c": point, f"{name}_dew_point_depression": t - point})
    return df


def terrain(elevation: Column) -> Column:
    """By metres; unknown is 0."""
    e = F.coalesce(elevation, F.lit(0.0))
    return F.when(e >= 400, "mountain").when(e >= 100, "upland").otherwise("lowland")


def with_region(df: DataFrame) -> DataFrame:
    """Region and region_class, each the other's where it is missing; both unknown where neither is there."""
    if "region_class" not in df.columns:
        df = df.withColumn("region_class", F.col("region") if "region" in df.columns else F.lit("unknown"))
    return df if "region" in df.columns else df.withColumn("region", F.col("region_class"))


def with_aliases(df: DataFrame, version: int = 2) -> DataFrame:
    """obs_ copies of the measures; version 1 has target_ copies too and no precipitation."""
    names = ["temp", "humidity", "pressure", "wind_speed"] + (["precipitation"] if version == 2 else [])
    new = {f"obs_{c}": F.col(c) for c in names if c in df.columns}
    if version == 1:
        new |= {f"target_{c}": F.col(c) for c in ("temp", "humidity") if c in df.columns}
    return df.withColumns(new)


def with_target(df: DataFrame, target: str) -> DataFrame:
    """P6."""
    return df.withColumns({"target_value": F.col(target).cast("double"), "target_name": F.lit(target)})
