"""Links between texts that share a bucket, decided exactly, and the classes they form.

Buckets that hold the same nodes are one. A bucket is dealt to blocks of bounded size, by a hash, and each
block's task decides every pair of its members that its own links have not joined yet, on the whole texts.
Where a bucket took several blocks and still holds several classes, its members outside the greatest class
then meet the rest of the bucket, tile by tile. A task sends only the links that joined two classes, so
what comes out is never more than what went in, and yet no pair of a bucket stays undecided.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, groups

#: Members of a block, and what all of their sizes come to.
BLOCK, BLOCK_SIZE = 1024, 4 << 20
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Links of the bags of one block or tile: (bags, sides, labels) -> pairs of places.
Decide = Callable[[list, np.ndarray | None, np.ndarray | None], list[tuple[int, int]]]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of `edges` (a, b): label is the least node of the connected component.

    Alternates large-star and small-star steps, each a minimum a node and a join back, until none
    changes an edge: about log(nodes) rounds, and no component is ever held in one place.
    """
    e = cut(_canonical(edges))
    before = _digest(e)
    while before[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = cut(_canonical(large))
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        small = small.select(F.col("a"), F.col("m").alias("b")).unionByName(low.select(F.col("b").alias("a"), F.col("m").alias("b")))
        e = cut(_canonical(small))
        now = _digest(e)
        if now == before:
            break
        before = now
    return cut(e.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("label"))).distinct())


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _digest(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


def _blocks(n: Column, size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(size / BLOCK_SIZE)).cast("int")


def linked(
    nodes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], bag: Callable, decide: Decide, kept: Callable[[DataFrame], DataFrame] = cut,
    start: DataFrame | None = None, across: bool = True,
) -> DataFrame:
    """(node, label) of the nodes that links join.

    `nodes` is (node, keys, size), one row a node, where `keys` names its buckets, a bounded number.
    `texts_of` gives (node, text, places) for a table of (node, places), each node once or more. Any two
    texts that meet in some bucket have been compared by `decide` on what `bag` makes of them, or were
    in one class already, so the classes are those of all links within buckets. `kept` materialises the
    table of buckets. `start` is (node, label) of classes known before, which the result contains. Without
    `across`, texts of different blocks of a bucket aren't compared, for a caller who looks again at
    the buckets that stay mixed.
    """
    member = nodes.select("node", "size", F.explode("keys").alias("bucket"))
    content = [F.count("*").alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(2))).alias("y")]
    buckets = member.groupBy("bucket").agg(*content).where("n > 1")
    buckets = buckets.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"), F.first("size").alias("size"))
    buckets = kept(buckets.select("bucket", _blocks(F.col("n"), F.col("size")).alias("k")))
    held = member.select("node", "bucket", "size").join(buckets, "bucket")
    block = F.pmod(F.xxhash64("node", "bucket"), F.col("k")).cast("int")
    held = held.groupBy("node").agg(F.collect_list(F.struct("bucket", block.alias("lo"), block.alias("hi"))).alias("places"))
    texts = texts_of(held)
    placed = texts.select("node", "text", F.lit(0).cast("long").alias("label"), F.lit(0).alias("side"), F.inline("places"))
    edges = cut(_decided(placed, bag, decide, False))
    if start is not None:
        edges = edges.unionByName(start.select(F.col("label").alias("a"), F.col("node").alias("b")))
    labels = components(edges)
    large = buckets.where("k > 1")
    if not across or large.isEmpty():
        return labels
    now = member.join(large.select("bucket"), "bucket").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    tiles = _tiles(cut(now))
    both = tiles.join(texts.select("node", "text").dropDuplicates(["node"]), "node")
    more = cut(_decided(both.select("node", "text", "label", "side", "bucket", "lo", "hi"), bag, decide, True))
    return labels if more.isEmpty() else components(edges.unionByName(more))


def _tiles(now: DataFrame) -> DataFrame:
    """(node, label, side, bucket, lo, hi): the tiles in which members (bucket, node, size, label) of mixed buckets meet.

    Members outside a bucket's greatest class are dealt to blocks by hash, and that class's to later
    blocks; a tile is two blocks, not both of the greatest class, or one block with itself.
    """
    by_label = now.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    top = by_label.groupBy("bucket").agg(F.max(F.struct("n", "label", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size")).where("n > top.n")
    rest = _blocks(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size"))
    top = top.select("bucket", F.col("top.label").alias("top"), rest.alias("rest"), _blocks(F.col("top.n"), F.col("top.size")).alias("tops"))
    outside = F.col("label") != F.col("top")
    hashed = F.xxhash64("node", F.lit("tile"))
    block = F.when(outside, F.pmod(hashed, F.col("rest"))).otherwise(F.col("rest") + F.pmod(hashed, F.col("tops"))).cast("int")
    others = F.sequence(F.lit(0), F.when(outside, F.col("rest") + F.col("tops") - 1).otherwise(F.col("rest") - 1))
    dealt = now.join(top, "bucket").withColumn("block", block).withColumn("other", F.explode(others))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    return dealt.select("node", "label", (F.col("block") == hi).cast("int").alias("side"), "bucket", lo.alias("lo"), hi.alias("hi"))


def _decided(placed: DataFrame, bag: Callable, decide: Decide, tiles: bool) -> DataFrame:
    """Links (a, b) within each (bucket, lo, hi) of `placed`; in `tiles`, across its two sides only unless it has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in groups(batches, ["bucket", "lo", "hi"]):
            node = group.column("node").to_numpy()
            _, first = np.unique(node, return_index=True)
            if len(first) < 2:
                continue
            bags = [bag(x) for x in group.column("text").take(pa.array(first)).to_pylist()]
            node = node[first]
            side = label = None
            if tiles:
                label = group.column("label").to_numpy()[first]
                side = group.column("side").to_numpy()[first] if group.column("lo")[0] != group.column("hi")[0] else None
            for i, j in decide(bags, side, label):
                a.append(node[i])
                b.append(node[j])
            if len(a) > 8192:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], schema=EDGES)
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], schema=EDGES)

    keys = ["bucket", "lo", "hi"]
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")
