"""Plan helpers the llm operators share: sources, durable cuts, bounded Arrow mapping, skew-proof ranks."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows per Arrow batch sent to Python; with the byte bound below it keeps workers small.
ARROW_ROWS = 512
#: Text bytes handled, and result bytes held, before a batch is handed back to the JVM.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: spark.checkpoint.dir. Where that is unset, a local one in local mode (tests), else an error."""
    sc = spark.sparkContext
    where = sc.getCheckpointDir()
    if where is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = where or tempfile.mkdtemp(prefix="shared-")
        sc.setCheckpointDir(where)
        where = sc.getCheckpointDir()
    return where


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder; survives lost executors, and Spark drops it with its last reference."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Session setting by which Spark deletes an execution's shuffle files when it ends.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Actions inside, checkpoints too, delete their shuffle files when they end."""
    before = spark.conf.get(FREE, "false")
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE, before)


def written(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Materialise as compressed Parquet in the shared folder; `free` deletes the shuffle files that made it at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE, "false")
    if free:
        spark.conf.set(FREE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if free:
            spark.conf.set(FREE, before)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Materialise as a table in the shared folder whose files are dealt by `key`, so that joins on it move the other side only."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").bucketBy(n, key).saveAsTable(name)
    return spark.table(name)


def dropped(df: DataFrame) -> None:
    """Delete what `written` made, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_of(df: DataFrame, name: str = "text") -> Column:
    return F.coalesce(df[name], F.lit(""))


def small_batches(spark: SparkSession) -> None:
    """Python workers get at most ARROW_ROWS rows at once; long texts would else arrive by the thousand."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the values of `column` would pass `limit` bytes; a longer value stands alone."""
    start = held = 0
    values = batch.column(column)
    if pa.types.is_string(values.type) or pa.types.is_binary(values.type):
        sizes = [n or 0 for n in pc.binary_length(values).to_pylist()]
    else:
        sizes = [-(-values.nbytes // max(1, len(values)))] * len(values)
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal `keys` (integers), from batches sorted by them."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for i, j in zip(starts, starts[1:]):
            key = tuple(c[i] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def add_columns(df: DataFrame, column: str, new: T.StructType, fn: Callable[[list], Sequence[Sequence]], keep: Sequence[str] | None = None, limit: int = SLICE_BYTES, raw: bool = False) -> DataFrame:
    """`df` with the columns `new`, which `fn` makes from a list of values of `column` (`raw`: from the Arrow array), slice by slice.

    Columns of `df` named as one of `new` are replaced; `keep` names those that stay (all by default).
    """
    names = {f.name for f in new}
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    small_batches(df.sparkSession)
    source = df.select(*[df[c] for c in kept], df[column].alias("__in"))
    schema = T.StructType([*(df.schema[c] for c in kept), *new])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__in", limit):
                values = part.column("__in")
                made = fn(values if raw else values.to_pylist())
                arrays = [part.column(i) for i in range(len(kept))]
                arrays += [x if isinstance(x, pa.Array) else pa.array(x, arrow.field(len(kept) + i).type) for i, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in arrow])

    return source.mapInArrow(run, schema)


def running(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over earlier rows of the same `keys`, by `bucket` then `order`.

    `bucket` must rise with `order`. A key's rows are spread over its buckets, so one that holds most
    of the table still is many tasks; only a row per key and bucket meets in one place.
    """
    df = df.withColumn("__v", value)
    sums = df.groupBy(*keys, bucket).agg(F.sum("__v").alias("__s"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(bucket).alias("__b"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__in", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    on = F.col(bucket) == F.col("__b")
    for c in same:
        on = on & c
    return df.join(sums, on, "inner").withColumn(name, F.col("__base") + F.col("__in")).drop("__v", "__in", "__base", "__b", *[f"__{k}" for k in keys])
