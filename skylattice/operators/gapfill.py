"""Gaps in ordered series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .slabs import NUMBER, SLAB, carried
from .slabs import numbered as in_slabs


def filled(name: str, limit: int, row: Column, past, ahead, carry: tuple[Column, Column] | None = None) -> Column:  # noqa: ANN001
    """Linear by row position, at most `limit` rows from either end of a gap, the rest as the last filled row; ends as their neighbour.

    For a gap of g rows between v0 and v1, row k of it gets v0 + (v1 - v0) * j / (g + 1), where j is k if
    g <= 2 * limit, k <= limit or k > g - limit, and else `limit`. `carry` has what is known before and after all of the window.
    """
    c = F.col(name).cast("double")
    here = F.when(c.isNotNull(), F.struct(row.alias("n"), c.alias("v")))
    before, after = F.last(here, ignorenulls=True).over(past), F.last(here, ignorenulls=True).over(ahead)
    if carry:
        before, after = F.coalesce(before, carry[0]), F.coalesce(after, carry[1])
    gap = after["n"] - before["n"] - 1
    k = row - before["n"]
    j = F.when((gap <= 2 * limit) | (k <= limit) | (k > gap - limit), k).otherwise(F.lit(limit))
    line = before["v"] + (after["v"] - before["v"]) * j / (gap + 1)
    return F.coalesce(c, F.when(before.isNotNull() & after.isNotNull(), line), before["v"], after["v"]).alias(name)


def fill_gaps(df: DataFrame, columns: Sequence[str], limit: int = 12, key: str = "station_id", order: str = "datetime", slab_rows: int | None = None) -> DataFrame:
    """`df` with the columns filled: what is before a row comes from one pass over its station, what is after from one pass back.

    With `slab_rows` a station is cut into slabs of so many rows, each a task of its own; slabs carry their last and next
    known values to one another, so the result is the same for any length.
    """
    until = (Window.unboundedPreceding, Window.currentRow)
    if slab_rows is None:
        station = Window.partitionBy(key)
        rows, carry = df.withColumn(NUMBER, F.row_number().over(station.orderBy(order))), {}
    else:
        station = Window.partitionBy(key, SLAB)
        rows = carried(in_slabs(df, slab_rows, [key], order), columns, [key])
        carry = {c: (F.col(f"__before_{c}"), F.col(f"__after_{c}")) for c in columns}
    past, ahead = station.orderBy(NUMBER).rowsBetween(*until), station.orderBy(F.desc(NUMBER)).rowsBetween(*until)
    new = {c: filled(c, limit, F.col(NUMBER), past, ahead, carry.get(c)) for c in columns}
    return rows.select(*[new.get(c, F.col(c)) for c in df.columns])


def raw_columns(columns: Sequence[str], version: int = 2, static_real: Sequence[str] = ()) -> list[str]:
    """The columns that are filled: obs_ and era5_; version 2 has the target, the coast's distance and real statics too."""
    found = {c for c in columns if c.startswith(("obs_", "era5_"))}
    if version == 2:
        found |= {c for c in columns if c in {"target_value", "coastal_distance_km", *static_real}}
    return sorted(found)
