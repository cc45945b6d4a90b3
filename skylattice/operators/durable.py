"""Tables that are used again and again, cut from their lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

#: Values that a part of a model's training rows holds, about.
VALUES = 1 << 16


def cut(df: DataFrame) -> DataFrame:
    """Cut from its lineage in the folder that executors share; where none is set, a local one in local mode, else an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if where is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="shared-"))
    return df.checkpoint()


def dealt(rows: DataFrame, width: int) -> DataFrame:
    """Cut training rows of `width` values in as many parts as their number asks for, at most as many as they came in.

    A model passes over its rows many times; parts left by a shuffle, mostly empty, would cost a task each in every pass.
    """
    rows = rows.persist()
    try:
        parts = max(1, -(-rows.count() * width // VALUES))
        return cut(rows.coalesce(parts))
    finally:
        rows.unpersist()
