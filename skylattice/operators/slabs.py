"""Long series in slabs of rows, so that one station is many tasks: numbers, halos and carried values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that slabs add: a row's number in its series from 0, the slab it belongs to, and the slab it is shown to.
NUMBER, SLAB, SHOWN = "__n", "__slab", "__shown"


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """Equal keys, nulls too."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"__of_{k}"]) for k in keys])


def _joined(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`df` with the columns of `small`, which has one row for each of its keys."""
    other = small.select(*[F.col(k).alias(f"__of_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    return df.join(other, _same(df, other, keys)).drop(*[f"__of_{k}" for k in keys])


def numbered(df: DataFrame, rows: int, keys: Sequence[str] = ("station_id",), order: str = "datetime") -> DataFrame:
    """Adds NUMBER and SLAB (of `rows` rows) along `order`, a time, nulls first.

    Rows are counted by spans of `rows` hours, the counts are added up span by span, and a row's number is what comes before
    its span and its place in it. A task sorts one span; rows of one time are all in one.
    """
    if rows < 1:
        raise ValueError("a slab has at least one row")
    span = F.coalesce(F.floor(F.unix_micros(F.col(order).cast("timestamp")) / F.lit(rows * 3.6e9)).cast("long"), F.lit(-(1 << 62)))
    df = df.withColumn("__span", span)
    counts = df.groupBy(*keys, "__span").agg(F.count("*").alias("__count"))
    before = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "__span", F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__base"))
    number = F.col("__base") + F.row_number().over(Window.partitionBy(*keys, "__span").orderBy(order)) - 1
    out = _joined(df, counts, [*keys, "__span"]).withColumn(NUMBER, number).drop("__base", "__span")
    return out.withColumn(SLAB, F.floor(F.col(NUMBER) / rows).cast("long"))


def with_halo(df: DataFrame, rows: int, before: int = 0, after: int = 0) -> DataFrame:
    """Rows of `numbered`, each shown to its own slab and to the next or last one if that needs it: SHOWN.

    A slab so sees the `before` rows ahead of it and the `after` rows behind it. `own` tells its rows from those.
    """
    if max(before, after) > rows:
        raise ValueError(f"slabs of {rows} rows are shorter than the {max(before, after)} rows looked at")
    at = F.col(NUMBER) % rows
    to = [F.col(SLAB), F.when(at >= rows - before, F.col(SLAB) + 1), F.when((at < after) & (F.col(SLAB) > 0), F.col(SLAB) - 1)]
    return df.withColumn(SHOWN, F.explode(F.filter(F.array(*to), lambda x: x.isNotNull())))


def own(df: DataFrame) -> DataFrame:
    """What slabs made of their own rows, without the columns that slabs add."""
    return df.where(F.col(SHOWN) == F.col(SLAB)).drop(NUMBER, SLAB, SHOWN)


def carried(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("station_id",)) -> DataFrame:
    """Rows of `numbered` with __before_{c} and __after_{c}: number and value (n, v) of the last known value before the slab, and of the first behind it.

    Only each slab's first and last known values meet in a station, one row a slab.
    """
    here = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(NUMBER).alias("n"), F.col(c).cast("double").alias("v"))) for c in columns}
    ends = df.groupBy(*keys, SLAB).agg(*[f(x).alias(f"__{name}_{c}") for c, x in here.items() for name, f in (("last", F.max), ("first", F.min))])
    slabs = Window.partitionBy(*keys).orderBy(SLAB)
    past, ahead = slabs.rowsBetween(Window.unboundedPreceding, -1), slabs.rowsBetween(1, Window.unboundedFollowing)
    of = [F.last(f"__last_{c}", ignorenulls=True).over(past).alias(f"__before_{c}") for c in columns]
    of += [F.first(f"__first_{c}", ignorenulls=True).over(ahead).alias(f"__after_{c}") for c in columns]
    return _joined(df, ends.select(*keys, SLAB, *of), [*keys, SLAB])
