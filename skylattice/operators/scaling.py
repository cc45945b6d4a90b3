"""Standardising columns by what the training rows say."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scaler:
    """`overall`: one row of {c}__mean, {c}__std; `by_group`: such a row a group, or None."""

    columns: tuple[str, ...]
    overall: dict[str, tuple[float, float]]
    by_group: DataFrame | None = None
    group: str = "station_id"

    def state(self) -> dict:
        """The scaler as a mapping for JSON; groups are collected, a row each."""
        groups = {} if self.by_group is None else {r[self.group]: {c: [r[f"{c}__mean"], r[f"{c}__std"]] for c in self.columns} for r in self.by_group.collect()}
        return {"columns": list(self.columns), "global": {c: list(v) for c, v in self.overall.items()}, "groups": groups}


def _usable(std: Column) -> Column:
    return F.when(std.isNull() | F.isnan(std) | (std <= 0), 1.0).otherwise(std)


def fit(train: DataFrame, columns: Sequence[str], mode: str = "global", group: str = "station_id") -> Scaler | None:
    """Mean and deviation over training rows, nulls passed over: of the population for all rows together, of a
    sample within a group (`station_wise`). A deviation of zero or none counts as 1. Mode `none` gives None."""
    if mode == "none":
        return None
    if mode not in ("global", "station_wise"):
        raise ValueError(f"unknown scaling mode {mode!r}")
    each = [x for c in columns for x in (F.avg(c).alias(f"{c}__mean"), _usable(F.stddev_pop(c)).alias(f"{c}__std"))]
    row = train.agg(*each).first()
    overall = {c: (row[f"{c}__mean"] if row[f"{c}__mean"] is not None else 0.0, row[f"{c}__std"]) for c in columns}
    groups = None
    if mode == "station_wise":
        own = [x for c in columns for x in (F.avg(c).alias(f"{c}__mean"), _usable(F.stddev_samp(c)).alias(f"{c}__std"))]
        groups = train.groupBy(group).agg(*own)
    return Scaler(tuple(columns), overall, groups, group)


def statistics(train: DataFrame, columns: Sequence[str], group: str | None = None) -> DataFrame:
    """The same as rows (group, column_name, mean, std), for reports and artifacts."""
    std = F.stddev_pop if group is None else F.stddev_samp
    keys = [] if group is None else [group]
    wide = train.groupBy(*keys).agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}__mean"), _usable(std(c)).alias(f"{c}__std"))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std")) for c in columns])).alias("r")
    return wide.select(*keys, rows).select(*keys, "r.*")


def _with_factors(df: DataFrame, scaler: Scaler) -> tuple[DataFrame, dict[str, tuple[Column, Column]]]:
    fixed = {c: (F.lit(float(m)), F.lit(float(s))) for c, (m, s) in scaler.overall.items()}
    if scaler.by_group is None:
        return df, fixed
    own = scaler.by_group.select(F.col(scaler.group).alias("__g"), *[F.col(f"{c}__{x}").alias(f"__{c}__{x}") for c in scaler.columns for x in ("mean", "std")])
    df = df.join(own, df[scaler.group] == own["__g"], "left").drop("__g")
    return df, {c: (F.coalesce(F.col(f"__{c}__mean"), m), F.coalesce(F.col(f"__{c}__std"), s)) for c, (m, s) in fixed.items()}


def transform(df: DataFrame, scaler: Scaler | None, columns: Sequence[str] | None = None) -> DataFrame:
    """(x - mean) / std; a group that was not in training gets the overall factors."""
    if scaler is None:
        return df
    keep = df.columns
    df, factors = _with_factors(df, scaler)
    return df.withColumns({c: (F.col(c) - factors[c][0]) / factors[c][1] for c in (columns or scaler.columns) if c in keep}).select(*keep)


def inverse(df: DataFrame, scaler: Scaler | None, values: dict[str, str]) -> DataFrame:
    """x * std + mean for `values`: column of `df` -> the scaled column whose factors it has."""
    if scaler is None:
        return df
    keep = df.columns
    df, factors = _with_factors(df, scaler)
    return df.withColumns({c: F.col(c) * factors[of][1] + factors[of][0] for c, of in values.items()}).select(*keep)
