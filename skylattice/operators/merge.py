"""Several observation feeds as one table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.schema import MEASURES


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows, columns by name, null where a part lacks one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge_by_priority(df: DataFrame, priority: str = "_priority", order: Sequence[str] = ()) -> DataFrame:
    """One row a station and time: of each column the first value that is there, least priority first.

    Rows of equal priority come in the order of the columns `order`, then by value.

    An empty quality flag is a value. `observation_source` is the first source name that isn't blank;
    `observation_sources` joins the distinct ones by commas, in order.
    """
    rank = F.struct(priority, *order)

    def first(name: str, keep):  # noqa: ANN001, ANN202
        return F.min(F.when(keep, F.struct(rank.alias("p"), F.col(name).alias("v"))))["v"].alias(name)

    named = F.trim(F.coalesce("observation_source", F.lit(""))) != ""
    values = [c for c in [*MEASURES, "quality_flag"] if c in df.columns]
    seen = F.collect_set(F.when(named, F.struct(rank.alias("p"), F.col("observation_source").alias("s"))))
    out = df.groupBy("station_id", "datetime").agg(
        *[first(c, F.col(c).isNotNull()) for c in values],
        first("observation_source", named),
        F.array_join(F.array_distinct(F.transform(F.array_sort(seen), lambda x: x["s"])), ",").alias("observation_sources"),
    )
    return out.withColumns({"observation_source": F.coalesce("observation_source", F.lit("")), "quality_flag": F.coalesce("quality_flag", F.lit(""))})
