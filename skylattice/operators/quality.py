"""What a time index holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.timefns import hours_between


def index_quality(df: DataFrame, key: str = "station_id", at: str = "datetime") -> DataFrame:
    """One row a station: start, end, rows, distinct times, repeated rows, missing hours."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key, at).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(at)
    there = F.col(at).isNotNull()
    gap = F.when(there, hours_between(F.lag(at).over(w), F.col(at)))
    return counts.withColumn("missing", F.greatest(F.floor(gap) - 1, F.lit(0))).groupBy(key).agg(
        F.min(at).alias("start"), F.max(at).alias("end"), F.sum("n").alias("row_count"), F.count(at).alias("timestamp_count"),
        F.sum(F.col("n") - 1).alias("duplicate_count"), F.coalesce(F.sum("missing"), F.lit(0)).cast("long").alias("missing_hour_count"),
    )


def station_count(df: DataFrame, key: str = "station_id") -> DataFrame:
    """A18."""
    return df.agg(F.count_distinct(key).alias("station_count"))


def split_summary(df: DataFrame, at: str = "datetime") -> DataFrame:
    """Rows, first and last time by split."""
    return df.groupBy("split").agg(F.count("*").alias("row_count"), F.min(at).alias("start"), F.max(at).alias("end"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows by value, nulls too."""
    return df.groupBy(column).agg(F.count("*").alias("row_count"))
