"""K2, K7-K9 on the session's file system: what appears there appears whole, and nobody's rows replace another's."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

#: Where writers prepare; never read.
STAGING = "_staging"


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))


def _context(spark: SparkSession, path: str):  # noqa: ANN202
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    full = _path(spark, path).getFileSystem(conf).makeQualified(_path(spark, path))
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(full.toUri(), conf), full


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder but for those that begin with `_` or `.`; none where it isn't there."""
    where = _path(spark, path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(n for n in names if n[0] not in "_.")


def move(spark: SparkSession, source: str, to: str, replace: bool = False) -> None:
    """One rename: `to` is either as it was or all of `source`. Without `replace` it is an error if `to` is there."""
    jvm = spark.sparkContext._jvm
    context, target = _context(spark, to)
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE if replace else option.NONE
    if not context.util().exists(target.getParent()):
        context.mkdir(target.getParent(), jvm.org.apache.hadoop.fs.permission.FsPermission.getDirDefault(), True)
    context.rename(_context(spark, source)[1], target, options)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside and renamed over what was there."""
    beside = f"{path.rpartition('/')[0]}/.{path.rpartition('/')[2]}-{uuid.uuid4().hex}"
    where = _path(spark, beside)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    move(spark, beside, path, replace=True)


def get_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is none."""
    where = _path(spark, path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return bytes(spark.read.format("binaryFile").load(path).first().content).decode()


def append(df: DataFrame, board: str) -> str:
    """Adds rows to a table of small appends: each is a folder of its own, written apart and renamed in, so appends at one time all stay."""
    spark, name = df.sparkSession, f"rows-{uuid.uuid4().hex}"
    df.write.parquet(f"{board}/{STAGING}/{name}")
    move(spark, f"{board}/{STAGING}/{name}", f"{board}/{name}")
    return name


def appended(spark: SparkSession, board: str) -> DataFrame | None:
    """All rows that were appended, with the columns of all appends; None where there are none."""
    names = children(spark, board)
    return spark.read.option("mergeSchema", True).parquet(*[f"{board}/{n}" for n in names]) if names else None


def publish(spark: SparkSession, root: str, name: str, texts: Mapping[str, str], tables: Mapping[str, DataFrame] | None = None) -> str:
    """K8: a run's folder `root`/`name` of texts and CSV tables; it appears when all is written, and a second run of the name is an error."""
    stage, place = f"{root}/{STAGING}/{uuid.uuid4().hex}", f"{root}/{name}"
    for file, df in (tables or {}).items():
        df.coalesce(1).write.option("header", True).csv(f"{stage}/{file}.csv")
    for file, text in texts.items():
        put_text(spark, f"{stage}/{file}", text)
    move(spark, stage, place)
    return place


def point(spark: SparkSession, root: str, alias: str, name: str) -> None:
    """K9: `alias` of a root becomes the run `name`, in one rename of a small file."""
    put_text(spark, f"{root}/{alias}.json", json.dumps({"run": name}))


def pointed(spark: SparkSession, root: str, alias: str) -> str | None:
    """The run that an alias names."""
    text = get_text(spark, f"{root}/{alias}.json")
    return None if text is None else json.loads(text)["run"]
