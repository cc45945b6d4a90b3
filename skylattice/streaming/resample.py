"""A4 over a stream: an extension, as the batch operator is what there is to match."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.operators.resample import DEFAULT_AGGREGATION, aggregated, seconds_of
from skylattice.schema import STANDARD_COLUMNS


def resample_stream(df: DataFrame, rule: str, lateness: str = "2 hours", aggregation: Mapping[str, str] | None = None) -> DataFrame:
    """Buckets of a stream of standard observations; rows later than `lateness` behind the newest are passed over."""
    how = {c: (aggregation or {}).get(c, DEFAULT_AGGREGATION.get(c, "last")) for c in STANDARD_COLUMNS[2:]}
    at = F.col("datetime").alias("t")
    bucket = F.window("datetime", f"{seconds_of(rule)} seconds")
    out = df.withWatermark("datetime", lateness).groupBy("station_id", bucket.alias("w")).agg(*[aggregated(c, h, at) for c, h in how.items()])
    return out.where("temp is not null").select("station_id", F.col("w.start").alias("datetime"), *STANDARD_COLUMNS[2:])
