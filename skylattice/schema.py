"""Table shapes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed: the columns of a standard observation table, in order.
STANDARD_COLUMNS = ["station_id", "datetime", "temp", "humidity", "pressure", "wind_speed", "precipitation", "quality_flag"]
MEASURES = ["temp", "humidity", "pressure", "wind_speed", "precipitation"]
STATION_COLUMNS = ["station_id", "lat", "lon", "elevation"]

OBSERVATION = T.StructType(
    [T.StructField("station_id", T.StringType()), T.StructField("datetime", T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in MEASURES]
    + [T.StructField("quality_flag", T.StringType())]
)
FORECAST_POINT = T.StructType(
    [T.StructField("station_id", T.StringType()), T.StructField("timestamp", T.TimestampType()), T.StructField("target_name", T.StringType()), T.StructField("prediction", T.DoubleType())]
)


def require(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    """`df`, if it has the columns; decided when the plan is built."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks required columns: {missing}")
    return df
