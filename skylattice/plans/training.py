"""Training tables as one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.physics import with_aliases, with_dew_points, with_region, with_target
from skylattice.functions.timefns import with_split, with_time_features
from skylattice.operators.gapfill import fill_gaps, raw_columns
from skylattice.operators.lags import DELTAS, LAGS, ROLLS, lag_features
from skylattice.operators.quality import index_quality
from skylattice.operators.spatial import at_stations
from skylattice.sources.metadata import load_stations
from skylattice.sources.observations import observations_of
from skylattice.sources.tables import cached_table, read_table


def joined(observations: DataFrame, grid_at_stations: DataFrame, stations: DataFrame) -> DataFrame:
    """Every observation, with the grid's values of its station and hour, and its station's attributes."""
    return observations.join(grid_at_stations, ["station_id", "datetime"], "left").join(stations, "station_id", "left")


def training_table_v1(observations: DataFrame, grid: DataFrame, stations: DataFrame, ends: Mapping, mode: str = "nearest") -> DataFrame:
    """Joins, time features, obs_ and target_ copies, gaps of the raw columns filled, split."""
    df = with_aliases(with_time_features(joined(observations, at_stations(grid, stations, mode), stations)), 1)
    df = fill_gaps(df, raw_columns(df.columns, 1), 12)
    return with_split(df, ends).withColumn("quality_flag", F.coalesce("quality_flag", F.lit("")))


def training_table_v2(observations: DataFrame, grid: DataFrame, stations: DataFrame, data: Mapping) -> DataFrame:
    """As D1, with dew points before gaps are filled, one target, and lag features. Order matters and is kept."""
    mode = data.get("era5", {}).get("extraction_mode", "nearest")
    df = with_time_features(joined(observations, at_stations(grid, stations, mode), stations))
    df = with_target(with_dew_points(with_aliases(with_region(df))), data["target_name"])
    static = data.get("features", {}).get("static_real", [])
    df = fill_gaps(df, raw_columns(df.columns, 2, static), int(data.get("cleaning", {}).get("interpolate_limit_hours", 12)))
    made = data.get("feature_engineering", {})
    df = lag_features(df, made.get("lag_features", LAGS), made.get("rolling_features", ROLLS), made.get("delta_features", DELTAS))
    return with_split(df, data["split"]).withColumn("quality_flag", F.coalesce("quality_flag", F.lit("")))


def build(spark: SparkSession, config: Mapping, version: int = 2) -> DataFrame:
    """From a config: sources to table."""
    observations = observations_of(spark, config)
    stations = load_stations(spark, config["paths"]["station_metadata_csv"])
    grid = read_table(spark, config["paths"]["era5_csv"])
    if version == 1:
        return training_table_v1(observations, grid, stations, config["data"]["split"], config["data"].get("era5", {}).get("extraction_mode", "nearest"))
    return training_table_v2(observations, grid, stations, config["data"])


def build_or_reuse(spark: SparkSession, config: Mapping, version: int = 2) -> DataFrame:
    """K3: keyed by the whole config, so that a change of settings is never missed."""
    return cached_table(spark, config["paths"]["output_training_table"], dict(config), lambda: build(spark, config, version))


def quality_report(table: DataFrame) -> dict:
    """K4: A9 as a mapping for JSON; a row a station is collected."""
    rows = [r.asDict() for r in index_quality(table).orderBy("station_id").collect()]
    return {"station_count": len(rows), "stations": rows}
