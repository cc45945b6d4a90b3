"""Categories and complete rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def level(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN))


def levels(train: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct values of each column over training rows; null is `unknown`. A model has a column a level, so they are few."""
    return {c: [r[0] for r in train.select(level(c).alias("v")).distinct().orderBy("v").collect()] for c in columns}


def one_hot(df: DataFrame, found: dict[str, list[str]]) -> DataFrame:
    """static_cat__{column}__{level} as 1.0 or 0.0; a value that training didn't have is 0 in all."""
    return df.withColumns({f"static_cat__{c}__{v}": F.when(level(c) == v, 1.0).otherwise(0.0) for c, vs in found.items() for v in vs})


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a value in every one of the columns."""
    return df.dropna(subset=list(columns))
