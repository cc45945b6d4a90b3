"""Sharding by vector bin packing: groups go where their need meets the residual capacity best."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, running
from .mixing import word_count

#: Groups above this share of a shard's bytes, tokens or rows are placed first, on the driver.
HEAVY_SHARE = 1 / 64
#: Shares of a shard above which groups are cut: the greatest that overfills no shard by CLOSE and one row more than the best of them.
SPLIT_SHARES = (1, 1 / 2, 1 / 4, 1 / 8)
CLOSE = 0.05
#: Rounds of lighter groups by their share of a shard, the last without a bound; each sees what those before left.
ROUND_SHARES = (1 / 1024, 1 / 16384, 0.0)
#: Groups packed together by one task, and rows of a range in which slots are counted.
CELL_GROUPS, SLOT_ROWS = 1_000, 50_000


def pack(needs: np.ndarray, room: np.ndarray, first: int = 0) -> np.ndarray:
    """The bin of each item: the one whose residual capacity has the greatest dot product with the item's need.

    `needs` is items x dimensions, `room` bins x dimensions, both in units of a bin's fair share, and
    items come largest first. A bin with less left in some dimension counts negative there. Ties go to
    the bins from `first` on, so that many packings side by side don't all favour bin 0.
    """
    room = np.roll(room, -first, axis=0).copy()
    out = np.empty(len(needs), np.int64)
    for i, need in enumerate(needs):
        k = int(np.argmax(room @ need))
        room[k] -= need
        out[i] = k
    return (out + first) % len(room)


def split_heavy(heavy: list[tuple], fair: np.ndarray, n_shards: int) -> tuple[list[tuple], np.ndarray]:
    """Chunks (h1, h2, first row, end row, shard) of heavy groups, and the room they leave in each shard.

    `heavy`: (h1, h2, rows, need of one row). Rows of a group are alike, so a group that can't stay whole if
    shards are to be equal is cut into chunks of at most HEAVY_SHARE in every dimension, each packed as a
    group of its own. Groups stay whole up to the greatest of SPLIT_SHARES at which the fullest shard is no fuller than
    CLOSE and a row above what the best of them gives: a cut has to buy equal shards. `fair` ends with a shard's rows.
    """
    tried = []
    for split in SPLIT_SHARES:
        cuts = []
        for h1, h2, rows, need in heavy:
            part = max(need / fair)
            step = rows if rows * part <= split else max(1, int(HEAVY_SHARE / part))
            cuts += [(h1, h2, a, min(rows, a + step), need) for a in range(0, rows, step)]
        size = np.array([(b - a) * need / fair for _, _, a, b, need in cuts]).reshape(-1, len(fair))
        order = np.argsort(-size.max(axis=1), kind="stable") if cuts else []
        room = np.ones((n_shards, len(fair)))
        placed = []
        for i in order:
            k = int(np.argmax(room @ size[i]))
            room[k] -= size[i]
            placed.append((*cuts[i][:4], k))
        tried.append((placed, room))
    best = max(room.min() for _, room in tried)
    return next(x for x in tried if min(x[1].min(), 0) >= min(best, 0) - CLOSE - 1 / max(fair[-1], 1))


def shard(docs: DataFrame, n_shards: int = 24, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, size, tokens, text_crc32, shard, slot of every row, with bytes, tokens and rows balanced jointly.

    Size is the UTF-8 bytes of the text (null: none) plus 8; tokens are words. Groups are equal texts
    and stay together, unless shards can't be equal with them whole (see `split_heavy`). Groups above
    HEAVY_SHARE are at most 3 * n_shards / HEAVY_SHARE, so they alone are brought to the driver, cut
    where they must be, and packed there. All other groups follow in rounds from large to small; those of a
    round are dealt to cells of about CELL_GROUPS and packed side by side, each cell against its part of the
    residual capacity that all before it left in the shards. Slots count from 0 in each shard by doc_id.

    Null text is the group of null texts (apart from empty ones), equal rows get slots in an arbitrary
    order, other columns are ignored, and an empty table gives none.
    """
    text = F.col(text_col)
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        word_count(text).alias("tokens"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.xxhash64(text, text.isNull()).alias("h1"),
        F.xxhash64(text.isNull(), F.lit(7), text).alias("h2"),
    )
    base = cut(base)
    groups = cut(base.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("words"), F.count("*").alias("rows")))
    total = groups.agg(F.sum("bytes"), F.sum("words"), F.sum("rows")).first()
    fair = np.maximum(np.array([x or 0 for x in total], float), 1) / n_shards
    dims = ("bytes", "words", "rows")
    part = F.greatest(*[F.col(c) / F.lit(float(f)) for c, f in zip(dims, fair, strict=True)])
    heavy = [(r.h1, r.h2, r.rows, np.array([r.bytes, r.words, r.rows]) / r.rows) for r in groups.where(part > HEAVY_SHARE).orderBy("h1", "h2").collect()]
    placed, room = split_heavy(heavy, fair, n_shards)
    rounds = [(part <= above) & (part > least) for above, least in zip((HEAVY_SHARE, *ROUND_SHARES), ROUND_SHARES, strict=False)]
    numbers = groups.agg(*[F.count_if(x) for x in rounds]).first()
    packed = None
    for one_round, n in zip(rounds, numbers, strict=True):
        some = groups.where(one_round).withColumn("cell", F.pmod("h1", F.lit(max(1, -(-n // CELL_GROUPS)))))
        some = cut(some.groupBy("cell").applyInPandas(_packer(room, fair), "h1 long, h2 long, shard int, bytes long, words long, rows long"))
        for r in some.groupBy("shard").agg(*[F.sum(c).alias(c) for c in dims]).collect():
            room[r.shard] -= np.array([r[c] for c in dims]) / fair
        packed = some if packed is None else packed.unionByName(some)
    packed = packed.select("h1", "h2", "shard")
    spark = docs.sparkSession
    chunks = spark.createDataFrame(
        pd.DataFrame(placed, columns=["c1", "c2", "from_row", "to_row", "to_shard"]).astype({"c1": "int64", "c2": "int64", "from_row": "int64", "to_row": "int64", "to_shard": "int32"}),
        "c1 long, c2 long, from_row long, to_row long, to_shard int",
    )
    names = F.broadcast(chunks.select("c1", "c2").distinct())
    key = (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2"))
    tail = base.join(names, key, "left_anti").join(packed, ["h1", "h2"])
    if placed:
        hot = base.join(names, key, "left_semi")
        hot = hot.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-int(total[2]) // 4_000)))))
        hot = running(hot, ["h1", "h2"], "bucket", [F.col("doc_id")], F.lit(1), "row_no")
        within = key & (F.col("row_no") >= F.col("from_row")) & (F.col("row_no") < F.col("to_row"))
        hot = hot.join(F.broadcast(chunks), within).select(*base.columns, F.col("to_shard").alias("shard"))
        tail = tail.unionByName(hot)
    order = [F.col("doc_id"), F.col("h1")]
    ranges = tail.repartitionByRange(max(1, -(-int(total[2] or 0) // SLOT_ROWS)), *order)
    ranges = cut(ranges.withColumn("bucket", F.spark_partition_id()))
    return running(ranges, ["shard"], "bucket", order, F.lit(1), "slot").select("doc_id", "size", "tokens", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def _packer(room: np.ndarray, fair: np.ndarray) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs one cell's groups (h1, h2, bytes, words, rows) against the cell's part of `room`, shards x dimensions."""
    room, n = room.copy(), len(room)

    def pack_cell(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["h1", "h2"])  # sums of floats depend on the order
        need = cell[["bytes", "words", "rows"]].to_numpy(float) / fair
        # What this cell may put in each shard: in proportion to the room left, filled by what the cell holds.
        left = np.maximum(room, 0)
        own = left / np.maximum(left.sum(axis=0), 1e-12) * need.sum(axis=0)
        scale = np.maximum(own.mean(axis=0), 1e-12)
        need, own = need / scale, own / scale
        order = np.lexsort((cell.h2, cell.h1, -need.max(axis=1)))
        shards = pack(need[order], own, int(cell["cell"].iloc[0]) % n)
        return cell.iloc[order][["h1", "h2", "bytes", "words", "rows"]].assign(shard=shards.astype(np.int32))[["h1", "h2", "shard", "bytes", "words", "rows"]]

    return pack_cell
