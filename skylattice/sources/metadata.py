"""The station dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.physics import terrain, with_region
from skylattice.schema import STATION_COLUMNS, require

from .tables import read_table


def enrich(df: DataFrame) -> DataFrame:
    """Region, coast distance and terrain class, where the table has none."""
    df = require(df, STATION_COLUMNS, "station metadata").withColumn("station_id", F.col("station_id").cast("string"))
    df = with_region(df)
    if "coastal_distance_km" not in df.columns:
        df = df.withColumn("coastal_distance_km", F.lit(None).cast("double"))
    return df if "terrain_class" in df.columns else df.withColumn("terrain_class", terrain(F.col("elevation").cast("double")))


def load_stations(spark: SparkSession, path: str) -> DataFrame:
    return enrich(read_table(spark, path))
