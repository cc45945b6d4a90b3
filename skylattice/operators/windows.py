"""Row numbers and sliding windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.timefns import hours_between

from .slabs import NUMBER, SHOWN, SLAB, numbered, with_halo


def with_row_index(df: DataFrame, key: str = "station_id", order: str = "datetime") -> DataFrame:
    """time_idx, rows before it in its station."""
    return df.withColumn("time_idx", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)


def with_hour_index(df: DataFrame, order: str = "datetime") -> DataFrame:
    """time_idx, whole hours since the first time of all; that one is an aggregate, not a window over all rows."""
    first = df.agg(F.min(order).alias("__first"))
    return df.join(F.broadcast(first), F.lit(True), "inner").withColumn("time_idx", F.floor(hours_between(F.col("__first"), F.col(order))).cast("int")).drop("__first")


def sliding(
    df: DataFrame,
    encoder: Sequence[str],
    decoder: Sequence[str],
    static: Sequence[str],
    targets: Sequence[str],
    encoder_length: int,
    horizon: int,
    contiguous: bool = True,
    key: str = "station_id",
    order: str = "datetime",
    split: str = "split",
    slab_rows: int | None = None,
) -> DataFrame:
    """One row a window: station_id, split, prediction_start, and arrays encoder, decoder, static, target.

    `contiguous` (version 2): over all of a station's rows, hour after hour, the encoder free to reach
    into an earlier split, every decoder row in one split. Otherwise (version 1): within a split, at
    every row that has enough rows after it, gaps or not. Starts that don't qualify are told by counts
    first; arrays are made of those only. With `slab_rows` a station is cut into slabs of so many starts, each a task of
    its own that also sees the rows its last windows need; the windows are the same.
    """
    n = encoder_length + horizon
    keys = [key] if contiguous else [key, split]
    if slab_rows is not None:
        df = with_halo(numbered(df, slab_rows, keys, order), slab_rows, after=n - 1)
    w = Window.partitionBy(*keys).orderBy(order) if slab_rows is None else Window.partitionBy(*keys, SHOWN).orderBy(NUMBER)
    whole, ahead = w.rowsBetween(0, n - 1), w.rowsBetween(encoder_length, n - 1)
    rows = F.collect_list(F.struct(order, *dict.fromkeys([*encoder, *decoder, *targets])))
    ok = F.count("*").over(whole) == n
    if contiguous:
        last = F.max(order).over(whole)
        ok = ok & (hours_between(F.col(order), last) == n - 1) & (F.min(split).over(ahead) == F.max(split).over(ahead)) & (F.count(split).over(ahead) == horizon)
    df = df.withColumns({"__ok": ok, "__split": F.first(split).over(ahead)})
    made = df.withColumn("__rows", F.when(F.col("__ok"), rows.over(whole))).where("__ok")
    made = made if slab_rows is None else made.where(F.col(SHOWN) == F.col(SLAB))
    past, future = F.slice("__rows", 1, encoder_length), F.slice("__rows", encoder_length + 1, horizon)

    def arrays(part: Column, names: Sequence[str]) -> Column:
        return F.transform(part, lambda x: F.array(*[x[c].cast("double") for c in names]) if names else F.array().cast("array<double>"))

    return made.select(
        key, F.col("__split").alias(split), F.element_at("__rows", encoder_length + 1)[order].alias("prediction_start"),
        arrays(past, encoder).alias("encoder"), arrays(future, decoder).alias("decoder"),
        (F.array(*[F.col(c).cast("double") for c in static]) if static else F.array().cast("array<double>")).alias("static"), arrays(future, targets).alias("target"),
    )


def varying(
    df: DataFrame,
    encoder: Sequence[str],
    decoder: Sequence[str],
    static: Sequence[str],
    targets: Sequence[str],
    longest: int,
    horizon: int,
    shortest: int | None = None,
    first: int | None = None,
    last_only: bool = False,
    key: str = "station_id",
    index: str = "time_idx",
    order: str = "datetime",
) -> DataFrame:
    """Windows with encoders of `shortest` to `longest` rows (`shortest` None: all of `longest`).

    A window predicts from each row that has `horizon` rows from itself on and as many rows before it as the shortest encoder,
    all one step of `index` apart; its encoder is as long as that and `longest` allow. `first` is the least index that may be
    predicted from: with rows of earlier splits in `df`, a split's windows reach back into those. `last_only` keeps each
    key's last window. Shorter encoders are filled up with zeros behind; encoder_length tells how many rows are real. Rows
    without an index are passed over, of rows that share one the first by `order` counts; nulls in columns stay null.
    """
    shortest = longest if shortest is None else shortest
    if not 0 < shortest <= longest or horizon < 1:
        raise ValueError("encoders have 1 to `longest` rows, and at least one row is predicted")
    same = Window.partitionBy(key, index).orderBy(order)
    rows = df.where(F.col(index).isNotNull()).withColumn("__no", F.row_number().over(same)).where("__no = 1")
    rows = rows.withColumn("__run", F.col(index) - F.row_number().over(Window.partitionBy(key).orderBy(index)))
    w = Window.partitionBy(key, "__run").orderBy(index)
    around = w.rowsBetween(-longest, horizon - 1)
    before, ahead = F.count("*").over(w.rowsBetween(-longest, -1)), F.count("*").over(w.rowsBetween(0, horizon - 1))
    found = rows.withColumns({"encoder_length": before.cast("int"), "__ahead": ahead})
    ok = (F.col("encoder_length") >= shortest) & (F.col("__ahead") == horizon)
    if first is not None:
        ok = ok & (F.col(index) >= first)
    items = F.collect_list(F.struct(order, *dict.fromkeys([*encoder, *decoder, *targets]))).over(around)
    made = found.withColumn("__rows", F.when(ok, items)).where(F.col("__rows").isNotNull())
    if last_only:
        made = made.withColumn("__no", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(index)))).where("__no = 1")
    n = F.col("encoder_length")
    past, future = F.slice("__rows", F.lit(1), n), F.slice("__rows", n + 1, F.lit(horizon))
    arrays = lambda part, names: F.transform(part, lambda x: F.array(*[x[c].cast("double") for c in names]) if names else F.array().cast("array<double>"))
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), F.lit(len(encoder))), F.lit(longest) - n)
    return made.select(
        key, *[c for c in ("split",) if c in df.columns], F.col(order).alias("prediction_start"), F.col(index).alias("prediction_idx"), "encoder_length",
        F.concat(arrays(past, encoder), zeros).alias("encoder"), arrays(future, decoder).alias("decoder"),
        (F.array(*[F.col(c).cast("double") for c in static]) if static else F.array().cast("array<double>")).alias("static"), arrays(future, targets).alias("target"),
    )


def flattened(windows: DataFrame) -> DataFrame:
    """`features`: encoder, decoder, static, end to end."""
    return windows.withColumn("features", F.concat(F.flatten("encoder"), F.flatten("decoder"), "static"))


def flattened_names(encoder: Sequence[str], decoder: Sequence[str], static: Sequence[str], encoder_length: int, horizon: int) -> list[str]:
    """What each place of `features` is."""
    names = [f"encoder_t-{encoder_length - k}:{c}" for k in range(encoder_length) for c in encoder]
    names += [f"decoder_t+{h}:{c}" for h in range(1, horizon + 1) for c in decoder]
    return names + [f"static:{c}" for c in static]


def persistence(windows: DataFrame, places: Sequence[int], period: int | None = None) -> DataFrame:
    """`predicted`, horizon x targets: the encoder's value `period` rows before its end (the last one without
    a period, or if the encoder is shorter), at each target's place in the encoder, for every step."""
    n = F.size("encoder")
    back = F.lit(1) if period is None else F.when(n >= period, F.lit(int(period))).otherwise(1)
    row = F.element_at("encoder", -back)
    return windows.withColumn("predicted", F.transform("target", lambda _: F.array(*[row[i] for i in places])))
