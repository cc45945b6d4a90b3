"""Gridded NetCDF files and zips of them; needs xarray, which the environment may lack."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators.spatial import KEYS

#: Fixed: the names that grid variables get.
NAMES = {"valid_time": "datetime", "time": "datetime", "latitude": "lat", "longitude": "lon", "t2m": "era5_t2m", "sp": "era5_sp", "u10": "era5_u10", "v10": "era5_v10", "tp": "era5_tp"}
DROPPED = ["expver", "number"]
VALUES = ["era5_t2m", "era5_sp", "era5_u10", "era5_v10", "era5_tp"]


def members(content: bytes) -> Iterator[bytes]:
    """The NetCDF files in a file: itself, or those of a zip."""
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in sorted(z.namelist()):
                if name.endswith(".nc"):
                    yield z.read(name)
    else:
        yield content


def read_netcdf(spark: SparkSession, path: str) -> DataFrame:
    """datetime, lat, lon and the values of all files under `path`, each file read by one task, members of a zip outer-joined."""
    try:
        import xarray  # noqa: F401
    except ModuleNotFoundError as e:
        raise RuntimeError("reading NetCDF needs xarray and a NetCDF engine, which are not installed") from e
    fields = ", ".join(["datetime timestamp", "lat double", "lon double", *(f"{v} double" for v in VALUES)])

    def rows(frames):  # noqa: ANN001, ANN202
        import xarray as xr

        for frame in frames:
            for no, content in ((i, m) for c in frame["content"] for i, m in enumerate(members(bytes(c)))):
                data = xr.open_dataset(io.BytesIO(content)).to_dataframe().reset_index()
                data = data.drop(columns=[c for c in DROPPED if c in data]).rename(columns=NAMES)
                yield data.reindex(columns=[*KEYS, *VALUES]).assign(member=no)

    files = spark.read.format("binaryFile").load(path).select("content")
    found = files.mapInPandas(rows, fields + ", member int")
    # Members hold different values of one grid: the first that is there, by member.
    return found.groupBy(*KEYS).agg(*[F.min(F.when(F.col(v).isNotNull(), F.struct("member", F.col(v).alias("v"))))["v"].alias(v) for v in VALUES])
