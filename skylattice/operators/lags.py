"""Lags, rolling statistics and deltas over rows of a station."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.timefns import hours_between

from .slabs import NUMBER, SHOWN, numbered, own, with_halo

Spec = Mapping[str, Sequence[int]]
#: Fixed: the features made unless a config has its own.
LAGS: Spec = {
    "target_value": [1, 3, 6, 12, 24, 48, 72],
    "obs_temp": [1, 3, 6, 24],
    "obs_humidity": [1, 3, 6, 24],
    "obs_pressure": [1, 6, 24],
    "obs_wind_speed": [1, 6, 24],
    "obs_dew_point_c": [1, 3, 6, 24],
    "obs_dew_point_depression": [1, 3, 6, 24],
    "era5_t2m": [1, 3, 6, 12, 24],
    "era5_sp": [1, 6, 24],
}
ROLLS: Spec = {"target_value": [3, 6, 12, 24], "obs_humidity": [6, 24], "obs_temp": [6, 24]}
DELTAS: Spec = {"target_value": [1, 6, 24], "obs_humidity": [1, 6, 24], "obs_temp": [1, 6, 24]}


def lag_features(df: DataFrame, lags: Spec = LAGS, rolls: Spec = ROLLS, deltas: Spec = DELTAS, key: str = "station_id", order: str = "datetime", exact_hours: bool = False, slab_rows: int | None = None) -> DataFrame:
    """`df` with {c}_lag_{k}, {c}_roll_mean_{n}, {c}_roll_std_{n}, {c}_delta_{k}, and what follows from them.

    All are by rows, as the data stands: a missing hour shifts them. `exact_hours` gives lags and deltas
    null unless the row k before is k hours before. Rolling statistics are of the n rows before the
    current one and null unless all n have values; the deviation is that of the population. One sort of
    each station serves every column. Columns that `df` lacks are passed over.
    With `slab_rows` a station is cut into slabs of so many rows (no fewer than any of them looks back), each a task of its
    own that also sees the rows it needs of the slab before; the result is the same.
    """
    if slab_rows is not None:
        back = max([0, *(int(k) for spec in (lags, rolls, deltas) for c, ks in spec.items() if c in df.columns for k in ks)])
        df = with_halo(numbered(df, slab_rows, [key], order), slab_rows, before=back)
    w = Window.partitionBy(key).orderBy(order) if slab_rows is None else Window.partitionBy(key, SHOWN).orderBy(NUMBER)
    new: dict[str, Column] = {}

    def back(c: str, k: int) -> Column:
        value = F.lag(c, k).over(w)
        return F.when(hours_between(F.lag(order, k).over(w), F.col(order)) == k, value) if exact_hours else value

    for c, ks in lags.items():
        if c in df.columns:
            new |= {f"{c}_lag_{k}": back(c, k) for k in sorted({int(k) for k in ks})}
    for c, ns in rolls.items():
        if c in df.columns:
            for n in sorted({int(n) for n in ns}):
                frame = w.rowsBetween(-n, -1)
                full = F.count(c).over(frame) == n
                new[f"{c}_roll_mean_{n}"] = F.when(full, F.avg(c).over(frame))
                new[f"{c}_roll_std_{n}"] = F.when(full, F.stddev_pop(c).over(frame))
    for c, ks in deltas.items():
        if c in df.columns:
            new |= {f"{c}_delta_{k}": F.col(c) - back(c, k) for k in sorted({int(k) for k in ks})}
    out = df.withColumns(new) if new else df
    out = out if slab_rows is None else own(out)
    if "target_value_lag_24" in out.columns:
        out = out.withColumns({"target_value_same_hour_prev_day": F.col("target_value_lag_24"), "target_value_diff_vs_prev_day": F.col("target_value") - F.col("target_value_lag_24")})
    if {"obs_humidity", "obs_temp"} <= set(out.columns):
        out = out.withColumn("humidity_temp_interaction", F.col("obs_humidity") * F.col("obs_temp"))
    return out
