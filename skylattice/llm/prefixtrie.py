"""The trie of shared conversation prefixes: union-find over the common prefixes of sorted neighbours, deepest first.

Conversations are sorted by their turns' keys, so all that share a prefix stand together. In each block of the sorted
rows an edge joins two neighbours at the depth of their longest common prefix. Edges are taken by falling depth; an edge
that joins two components makes a node there, or adds to the one that is there. What lies on the path of a block's
first or last conversation is open: other blocks may hold more of it. Everything else is closed and final. Open nodes
carry what their closed children sum up to (the block's forest, contracted), and blocks meet on the open nodes' keys.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut, small_batches, written

#: Conversations, and characters of their paths, in one block.
BLOCK_ROWS, BLOCK_CHARS = 1 << 16, 64 << 20
#: Characters of a turn's key in a path.
KEY = 32
#: Ids of one chunk of a long list of ended conversations.
CHUNK = 8192
NO_ENDS = hashlib.sha256(b"").hexdigest()
CLOSED, OPEN, ENDED = 0, 1, 2

FOREST = T.StructType(
    [T.StructField(x, T.LongType()) for x in ("block", "kind", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "words", "seq")]
    + [T.StructField(x, T.BooleanType()) for x in ("left", "right")]
    + [T.StructField(x, T.StringType()) for x in ("key", "parent_key", "ends")]
)


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, key, words) of each turn, by turn with nulls first, then role, then text; rows without conv_id belong to no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), role, text)
    return turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.row_number().over(order).cast("long").alias("pos"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("key"),
        F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long").alias("words"),
    )


def paths(own: DataFrame, base: Column | None = None, head: Column | None = None, most: int | None = None) -> DataFrame:
    """(conv_id, path, words): the keys of each conversation's turns in a row, and the words of each.

    With `base` and `head` (of conv_id; `head` at most `most`), a conversation's first `head` turns give way to as many of conversation `base`:
    all of them if it has fewer, none if there is no such conversation. A conversation may be left without turns.
    """
    if base is None:
        rows = own.select("conv_id", F.lit(1).alias("part"), "pos", "key", "words")
    else:
        every = own.where("pos = 1").select("conv_id", base.alias("__base"), head.alias("__head"))
        first = own.where(F.col("pos") <= most).select(F.col("conv_id").alias("__base"), "pos", "key", "words")
        heads = every.join(first, "__base").where(F.col("pos") <= F.col("__head")).select("conv_id", F.lit(0).alias("part"), "pos", "key", "words")
        tails = own.where(F.col("pos") > head).select("conv_id", F.lit(1).alias("part"), "pos", "key", "words")
        none = every.select("conv_id", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("pos"), F.lit("").alias("key"), F.lit(0).cast("long").alias("words"))
        rows = heads.unionByName(tails).unionByName(none)
    turns = rows.groupBy("conv_id").agg(F.filter(F.array_sort(F.collect_list(F.struct("part", "pos", "key", "words"))), lambda x: x["part"] >= 0).alias("turns"))
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda x: x["key"]), "").alias("path"), F.transform("turns", lambda x: x["words"]).alias("words"))


def common(a: str, b: str) -> int:
    """Turns that two paths share from their beginning."""
    most = min(len(a), len(b)) // KEY
    if a[: most * KEY] == b[: most * KEY]:
        return most
    return bisect_left(range(1, most + 1), True, key=lambda d: a[: d * KEY] != b[: d * KEY])


def components(lcp: list[int], lengths: list[int], ids: list[int]) -> tuple[list[int], list[int], list[int], list[int], list[list[int]], int]:
    """Depth, first and last member, least id and children of the nodes that merges make; the last node is the root.

    Conversations are nodes at their own length; an edge of that depth adds to such a node, so copies are one node.
    """
    m = len(ids)
    depth, lo, hi, least, children = list(lengths), list(range(m)), list(range(m)), list(ids), [[] for _ in range(m)]
    top, up = list(range(m)), list(range(m))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for i in np.argsort(-np.asarray(lcp, np.int64), kind="stable").tolist():
        at, a, b = lcp[i], find(i), find(i + 1)
        x, y = top[a], top[b]
        if depth[x] != at and depth[y] != at:
            depth.append(at)
            lo.append(lo[x])
            hi.append(hi[y])
            least.append(min(least[x], least[y]))
            children.append([x, y])
            made = len(depth) - 1
        else:
            made, other = (x, y) if depth[x] == at else (y, x)
            lo[made], hi[made], least[made] = lo[x], hi[y], min(least[x], least[y])
            if depth[other] == at:
                children[made] += children[other]
                depth[other] = -1  # no node any more
            else:
                children[made].append(other)
        up[b] = a
        top[a] = made
    last = top[find(0)]
    if depth[last] > 0:
        depth.append(0)
        lo.append(0)
        hi.append(m - 1)
        least.append(least[last])
        children.append([last])
        last = len(depth) - 1
    return depth, lo, hi, least, children, last


def block_rows(block: int, ids: list[int], path: list[str], words: list[list[int]], chunk: int) -> Iterator[tuple]:
    """The rows of FOREST of one block of sorted conversations."""
    m = len(ids)
    lengths = [len(x) // KEY for x in path]
    depth, lo, hi, least, children, root = components([common(a, b) for a, b in zip(path, path[1:])], lengths, ids)
    above = {c: v for v in range(len(depth)) if depth[v] >= 0 for c in children[v]}
    closed_n, closed_leaves, closed_saved = [0] * len(depth), [0] * len(depth), [0] * len(depth)
    is_open = [a == 0 or b == m - 1 for a, b in zip(lo, hi)]
    key = lambda v, d: hashlib.md5(path[lo[v]][: d * KEY].encode()).hexdigest()
    for v in sorted((v for v in range(len(depth)) if depth[v] >= 0), key=lambda v: -depth[v]):
        u = above.get(v)
        n, bottom, ends = hi[v] - lo[v] + 1, depth[v], 0
        while ends < n and lengths[lo[v] + ends] == bottom:
            ends += 1
        ended = ids[lo[v] : lo[v] + ends]
        leaves, saved, kids = closed_leaves[v] if children[v] or is_open[v] else 1, closed_saved[v], closed_n[v]
        said = words[lo[v]]
        for d in range(bottom, depth[u] if u is not None else -1, -1):
            w = said[d - 1] if d else 0
            if is_open[v]:
                yield block, OPEN, d, least[v], None, n, kids, leaves, saved, w, None, lo[v] == 0, hi[v] == m - 1, key(v, d), key(v, d - 1) if d else None, None
                if d == bottom:
                    for i in range(0, ends, chunk):
                        yield (block, ENDED, d, *[None] * 7, i, None, None, key(v, d), None, ",".join(map(str, ended[i : i + chunk])))
                leaves = saved = kids = 0
                continue
            saved += (n - 1) * w
            parent, parent_key = least[v], None
            if d == depth[u] + 1:
                parent, parent_key = (None, key(v, d - 1)) if is_open[u] else (least[u], None)
            yield block, CLOSED, d, least[v], parent, n, kids, leaves, saved, w, None, False, False, None, parent_key, hashlib.sha256(",".join(map(str, ended if d == bottom else ())).encode()).hexdigest()
            kids = 1
        if not is_open[v]:
            closed_n[u] += 1
            closed_leaves[u] += leaves
            closed_saved[u] += saved


def forest(sorted_paths: DataFrame) -> DataFrame:
    """FOREST's rows of every block; the paths must be sorted over all partitions."""
    small_batches(sorted_paths.sparkSession)
    arrow, chunk = to_arrow_schema(FOREST), CHUNK

    def record(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids, path, words, held = [], [], [], 0

        def done() -> Iterator[pa.RecordBatch]:
            rows = []
            for row in block_rows(block, ids, path, words, chunk):
                rows.append(row)
                if len(rows) >= 4096:
                    yield record(rows)
                    rows = []
            if rows:
                yield record(rows)

        for batch in batches:
            for i, p, w in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "path", "words")), strict=True):
                if ids and (len(ids) >= BLOCK_ROWS or held + len(p) > BLOCK_CHARS):
                    yield from done()
                    block, ids, path, words, held = block + 1, [], [], [], 0
                ids.append(i)
                path.append(p)
                words.append(w)
                held += len(p)
        if ids:
            yield from done()

    return sorted_paths.select("conv_id", "path", "words").mapInArrow(run, FOREST)


def ended(chunks: DataFrame) -> DataFrame:
    """(key, ends): the hash of each key's chunks in order, joined by commas; a task reads them one by one, whatever their number."""
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.select("key", "block", "seq", "ends").repartition(n, "key").sortWithinPartitions("key", "block", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, digest = None, None
        for batch in batches:
            out = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if key != here:
                    if here is not None:
                        out.append((here, digest.hexdigest()))
                    here, digest = key, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["key", "ends"])
        if here is not None:
            yield pa.RecordBatch.from_arrays([pa.array([here]), pa.array([digest.hexdigest()])], names=["key", "ends"])

    return dealt.mapInArrow(run, "key string, ends string")


def merged(rows: DataFrame) -> DataFrame:
    """The trie's nodes from the blocks' forests: closed nodes as they are, open ones summed over their blocks.

    A block's open nodes lie on two paths, to its first and to its last conversation. What hangs on an open node anywhere
    is counted once, on one path of one block, and summed upwards along that path.
    """
    spine = rows.where(F.col("kind") == OPEN)
    nodes = spine.groupBy("key").agg(
        F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("closed_children"),
        F.max("words").alias("words"), F.max("parent_key").alias("parent_key"), F.min("block").alias("home"),
    )
    under = nodes.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("open_children"))
    nodes = cut(nodes.join(under, "key", "left").withColumn("n_children", F.col("closed_children") + F.coalesce("open_children", F.lit(0))))
    about = nodes.select("key", "home", F.col("conv_id").alias("least"), ((F.col("n_convs") - 1) * F.col("words")).alias("saves"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    both = cut(spine.select("block", "key", "depth", "left", "right", "n_leaves", "saved_tokens").join(about, "key"))
    sided = both.withColumn("side", F.explode(F.filter(F.array(F.when(F.col("left"), 0), F.when(F.col("right"), 1)), lambda x: x.isNotNull())))
    counts = (F.col("side") == 0) | ~F.col("left")
    at_home = F.col("block") == F.col("home")
    down = Window.partitionBy("block", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    here = lambda own, kept: F.sum(F.when(counts, F.col(own) + F.when(at_home, F.col(kept)).otherwise(0)).otherwise(0)).over(down)
    sums = sided.select("key", here("n_leaves", "leaf").alias("a"), here("saved_tokens", "saves").alias("b")).groupBy("key").agg(F.sum("a").alias("n_leaves"), F.sum("b").alias("saved_tokens"))
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    ends = ended(rows.where(F.col("kind") == ENDED))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    open_ = nodes.join(sums, "key").join(parents, "parent_key", "left").join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_ENDS)))
    closed = rows.where(F.col("kind") == CLOSED).withColumnRenamed("ends", "ends_sha256")
    inner = closed.where("parent_key is null").select(*columns)
    # Nodes right below an open one: a block's own open nodes name the parent, so a prefix of many blocks is no hot key.
    outer = closed.where("parent_key is not null").drop("parent_conv_id").join(both.select("block", F.col("key").alias("parent_key"), F.col("least").alias("parent_conv_id")), ["block", "parent_key"])
    return inner.unionByName(outer.select(*columns)).unionByName(open_.select(*columns))


def trie(turns: DataFrame, base: Column | None = None, head: Column | None = None, most: int | None = None) -> DataFrame:
    """A row per node of the trie of all conversations' turns (role, text).

    Takes conv_id, turn, role, text; other columns are ignored. Turns are ordered by turn (null first), then role, then
    text; null role and text are empty. `base` and `head` (expressions of conv_id) replace a conversation's first turns,
    see `paths`. Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256; an empty table has no node. A conversation's path is one row of 40 bytes a turn: the longest
    conversation must fit a task, the most copies of one need not.
    """
    own = numbered(turns)
    spark = turns.sparkSession
    rows = cut(paths(cut(own) if base is not None else own, base, head, most))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return merged(written(forest(rows.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")), "forest"))
