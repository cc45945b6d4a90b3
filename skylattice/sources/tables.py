"""Reading and writing tables by suffix."""

from __future__ import annotations

import json
import shutil
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from skylattice.config import digest


def suffix_of(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2].rpartition(".")[2].lower()


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table by suffix: csv with a header, parquet or pq, nc. Give csv a schema where it is large: to infer one is another scan."""
    path, kind = str(path), suffix_of(str(path))
    if kind not in ("csv", "parquet", "pq", "nc"):
        raise ValueError(f"unsupported table format: {path}")
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if kind == "csv":
        reader = spark.read.option("header", True)
        if schema:
            return reader.schema(schema).csv(path)
        # Times without an offset stay without one: what zone they are of is the reader's to say.
        kinds = reader.option("inferSchema", True).csv(path).schema
        return reader.schema(T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.TimestampType) else f.dataType) for f in kinds])).csv(path)
    if kind == "nc":
        from .netcdf import read_netcdf

        return read_netcdf(spark, path)
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def write_table(df: DataFrame, path: str) -> str:
    path, kind = str(path), suffix_of(str(path))
    if kind == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif kind in ("parquet", "pq"):
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unsupported table format: {path}")
    return path


def write_json(data: object, path: str | Path) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(data, indent=2, ensure_ascii=True, default=str), encoding="utf-8")
    return path


def cached_table(spark: SparkSession, path: str, config: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """K3: the table made from `config`, kept as parquet beside `path` under the config's digest and reused only for that config."""
    place = f"{path}.{digest(config)}.parquet"
    if not exists(spark, f"{place}/_SUCCESS"):
        make().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def local_copy(source: str, target: str) -> str:
    """A file that is already here instead of a download."""
    if not Path(source).exists():
        raise FileNotFoundError(source)
    Path(target).parent.mkdir(parents=True, exist_ok=True)
    shutil.copyfile(source, target)
    return target
