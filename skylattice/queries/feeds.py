"""The driver's tables seen as station data: events as observations, lineitem as a grid, suppliers as stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.operators.resample import resample
from skylattice.schema import MEASURES

ENDS = {"train_end": "2024-01-20 23:00:00", "val_end": "2024-01-25 23:00:00", "test_end": "2024-01-30 23:00:00"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations between hours; users of even and odd id are two feeds (`side`)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("station_id"), F.col("ts").cast("timestamp").alias("datetime"), F.col("value").alias("temp"),
        F.when(F.col("user_id") % 6 != 0, F.get_json_object("props", "$.k").cast("double")).alias("humidity"), F.col("user_id").cast("double").alias("pressure"),
        (F.col("user_id") % 17).cast("double").alias("wind_speed"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("precipitation"),
        F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("q"), (F.col("event_id") % 5).cast("string"))).alias("quality_flag"), (F.col("user_id") % 2).alias("side"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(raw(spark, sf_dir), "1h")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly rows of every station from the first to the last hour of the month, empty where nothing was seen."""
    h = hourly(spark, sf_dir)
    hours = F.explode(F.sequence(F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-30 23:00:00").cast("timestamp"), F.expr("interval 1 hour"))).alias("datetime")
    return h.select("station_id").distinct().select("station_id", hours).join(h, ["station_id", "datetime"], "left")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a kind of event, with made-up attributes."""
    n = F.length("station_id")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("station_id")).distinct().select(
        "station_id", (n * 1.25).alias("lat"), (n * 2.5).alias("lon"), (n * 70.0 - 250).alias("elevation"),
        F.when(n > 5, "north").when(n > 4, "south").alias("region"), (n * 3.0).alias("coastal_distance_km"),
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly mean prices and discounts on a lattice of line number x month, a fifth of its points missing."""
    li = table(spark, sf_dir, "lineitem")
    lat, lon = F.col("l_linenumber").cast("double"), F.month("l_shipdate").cast("double")
    g = li.groupBy(F.date_trunc("year", "l_shipdate").cast("timestamp").alias("datetime"), lat.alias("lat"), lon.alias("lon"))
    return g.agg(F.avg("l_extendedprice").alias("era5_t2m"), F.avg("l_discount").alias("era5_sp")).where("(lat * 3 + lon) % 5 <> 0")


def grid_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(s.cast("string").alias("station_id"), ((s % 70) / 10 + 0.5).alias("lat"), ((s % 130) / 10).alias("lon"))


def persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of temperature and humidity as the row before, where that is one hour before."""
    from pyspark.sql import Window

    from skylattice.functions.timefns import hours_between, season

    h = hourly(spark, sf_dir)
    w = Window.partitionBy("station_id").orderBy("datetime")
    h = h.withColumns({"p_temp": F.lag("temp").over(w), "p_humidity": F.lag("humidity").over(w), "gap": hours_between(F.lag("datetime").over(w), F.col("datetime"))})
    pair = F.explode(F.array(*[F.struct(F.lit(t).alias("target_name"), F.col(f"p_{t}").alias("prediction"), F.col(t).alias("actual")) for t in ("temp", "humidity")])).alias("x")
    out = h.where("gap = 1").select("station_id", "datetime", pair).select("station_id", F.col("datetime").alias("valid_time"), "x.*").where("prediction is not null and actual is not null")
    hour = F.hour("valid_time")
    return out.withColumns(
        {
            "prediction_start": F.date_trunc("day", "valid_time"), "horizon_step": hour + 1, "season": season(F.month("valid_time")),
            "region": F.when(F.length("station_id") > 5, "north").when(F.length("station_id") > 4, "south"),
        }
    )


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, timestamps without zone, as the SQL gives them."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, digits) + F.lit(0.0)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.IntegerType):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


RAW = """raw AS (SELECT event_type AS station_id, ts AS datetime, value AS temp,
  CASE WHEN user_id % 6 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS humidity, user_id::DOUBLE AS pressure, (user_id % 17)::DOUBLE AS wind_speed,
  CASE WHEN event_type = 'purchase' THEN value END AS precipitation, CASE WHEN event_id % 3 > 0 THEN 'q' || (event_id % 5) END AS quality_flag, user_id % 2 AS side FROM events)"""


def bucketed(name: str, where: str = "true") -> str:
    return f"""{name} AS (SELECT station_id, date_trunc('hour', datetime)::TIMESTAMP AS datetime, avg(temp) AS temp, avg(humidity) AS humidity, avg(pressure) AS pressure,
  avg(wind_speed) AS wind_speed, coalesce(sum(precipitation), 0::DOUBLE) AS precipitation,
  max(struct_pack(t := datetime, v := quality_flag)) FILTER (WHERE quality_flag IS NOT NULL).v AS quality_flag
  FROM raw WHERE {where} GROUP BY 1, 2 HAVING avg(temp) IS NOT NULL)"""


HOURLY = f"WITH {RAW},\n{bucketed('hourly')}"
SERIES = HOURLY + """,
hours AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS datetime),
series AS (SELECT s.station_id, t.datetime, h.* EXCLUDE (station_id, datetime) FROM (SELECT DISTINCT station_id FROM hourly) s CROSS JOIN hours t LEFT JOIN hourly h ON h.station_id = s.station_id AND h.datetime = t.datetime)"""
STATIONS = """stations AS (SELECT station_id, length(station_id) * 1.25::DOUBLE AS lat, length(station_id) * 2.5::DOUBLE AS lon, length(station_id) * 70::DOUBLE - 250 AS elevation,
  CASE WHEN length(station_id) > 5 THEN 'north' WHEN length(station_id) > 4 THEN 'south' END AS region, length(station_id) * 3::DOUBLE AS coastal_distance_km
  FROM (SELECT DISTINCT event_type AS station_id FROM events))"""
GRID = """grid AS (SELECT date_trunc('year', l_shipdate)::TIMESTAMP AS datetime, l_linenumber::DOUBLE AS lat, month(l_shipdate)::DOUBLE AS lon, avg(l_extendedprice) AS era5_t2m, avg(l_discount) AS era5_sp
  FROM lineitem WHERE (l_linenumber * 3 + month(l_shipdate)) % 5 <> 0 GROUP BY 1, 2, 3),
points AS (SELECT s_suppkey::VARCHAR AS station_id, (s_suppkey % 70) / 10::DOUBLE + 0.5::DOUBLE AS s_lat, (s_suppkey % 130) / 10::DOUBLE AS s_lon FROM supplier)"""
SEASON = "CASE WHEN month({0}) IN (12, 1, 2) THEN 'winter' WHEN month({0}) IN (3, 4, 5) THEN 'spring' WHEN month({0}) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END"
PERSISTED = HOURLY + f""",
lagged AS (SELECT *, lag(temp) OVER w AS p_temp, lag(humidity) OVER w AS p_humidity, datetime - lag(datetime) OVER w AS gap FROM hourly WINDOW w AS (PARTITION BY station_id ORDER BY datetime)),
persisted AS (SELECT *, date_trunc('day', valid_time)::TIMESTAMP AS prediction_start, hour(valid_time) + 1 AS horizon_step, {SEASON.format('valid_time')} AS season,
  CASE WHEN length(station_id) > 5 THEN 'north' WHEN length(station_id) > 4 THEN 'south' END AS region FROM (
  SELECT station_id, datetime AS valid_time, 'temp' AS target_name, p_temp AS prediction, temp AS actual FROM lagged WHERE gap = INTERVAL 1 HOUR
  UNION ALL SELECT station_id, datetime, 'humidity', p_humidity, humidity FROM lagged WHERE gap = INTERVAL 1 HOUR) WHERE prediction IS NOT NULL AND actual IS NOT NULL)"""
ERRORS = """round(sqrt(avg((prediction - actual) * (prediction - actual))), 6) AS rmse, round(avg(abs(prediction - actual)), 6) AS mae, round(avg(prediction - actual), 6) AS bias,
  round(100::DOUBLE * avg(CASE WHEN abs(actual) >= 1e-6 THEN abs(prediction - actual) / abs(actual) END), 6) AS mape"""
SPLIT = f"CASE WHEN datetime <= TIMESTAMP '{ENDS['train_end']}' THEN 'train' WHEN datetime <= TIMESTAMP '{ENDS['val_end']}' THEN 'val' WHEN datetime <= TIMESTAMP '{ENDS['test_end']}' THEN 'test' ELSE 'holdout' END"
MEASURE_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in MEASURES)
