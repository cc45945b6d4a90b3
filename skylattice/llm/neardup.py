"""MinHash near-dedup over multisets of five-word shingles: BagMinHash signatures, bands, verified overlap."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bagminhash as bmh
from .common import add_columns, cut, dropped, small_batches, text_of, written
from .links import linked

#: Least multiset Jaccard of a link.
ALIKE = 0.8
KEYS = T.StructType([T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("size", T.LongType())])


def _keys(texts: list) -> tuple:
    """Buckets and number of shingles of each text; equal texts of a slice are signed once."""
    own = {x: i for i, x in enumerate(dict.fromkeys(texts))}
    bags = [bmh.bag(x) for x in own]
    keys = bmh.band_keys(bmh.signatures(bags)).view(np.int64)
    keys = [k.tolist() if len(b[0]) else [] for k, b in zip(keys, bags, strict=True)]
    at = [own[x] for x in texts]
    return [keys[i] for i in at], [int(bags[i][1].sum()) for i in at]


def _decide(bags: list, side: np.ndarray | None, label: np.ndarray | None) -> list[tuple[int, int]]:
    return bmh.links(bags, ALIKE, side, label)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id of every document: near copies, and copies of near copies, share a class.

    class_id is the least doc_id of the class. Equal texts are one node from the start, however many,
    so only distinct texts meet in buckets; a node is the 64-bit hash of its text. Two texts link when
    the multiset Jaccard of their five-word shingles is at least ALIKE; texts of fewer words are one
    shingle. Every pair that shares a band is decided on whole texts; a pair at the threshold shares none
    of the 20 bands, and is missed, with probability (1 - 0.8^4)^20, about 3 in 100,000.

    Null texts are empty; all texts without words form no link but equal ones are one class. Null ids are
    kept, in a class whose least id is null only if all its ids are. Equal rows are kept each; other
    columns are ignored; an empty table gives no row.
    """
    ids, nodes = _classified(docs, id_col, text_col)
    return ids.join(nodes, "node").select("doc_id", "class_id")


def _classified(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of every row and (node, class_id, head) of every text; head is the node that holds class_id."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    base = base.withColumn("node", F.xxhash64("text"))
    ids = base.select("doc_id", "node")
    signed = add_columns(base, "text", KEYS, _keys, ["doc_id", "node"])
    signed = signed.groupBy("node").agg(F.min("doc_id").alias("first"), F.any_value("keys").alias("keys"), F.max("size").alias("size"))
    signed = written(signed, "signed")
    scratch = [signed]

    def texts_of(places: DataFrame) -> DataFrame:
        """Read once, from the row of least id: of equal texts, however many, one meets the places."""
        wanted = signed.select("node", "first").join(places, "node").withColumnsRenamed({"node": "__node", "first": "doc_id"})
        on = base.doc_id.eqNullSafe(wanted.doc_id) & (base.node == wanted["__node"])
        scratch.append(written(base.join(wanted, on).select(base.node, base.text, wanted.places), "texts"))
        return scratch[-1]

    labels = linked(signed, texts_of, bmh.bag, _decide)
    nodes = signed.select("node", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node")).alias("least")
    heads = nodes.groupBy("label").agg(least).select("label", F.col("least.first").alias("class_id"), F.col("least.node").alias("head"))
    nodes = cut(nodes.join(heads, "label").select("node", "class_id", "head"))
    for x in scratch:
        dropped(x)
    return ids, nodes


def one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` of which each class keeps one: that of least id, null last; equal rows leave one."""
    _, nodes = _classified(docs, id_col, text_col)
    kept = nodes.where("node = head").select(F.col("class_id").alias("__id"), F.col("node").alias("__node"))
    marked = docs.withColumn("__text", F.xxhash64(text_of(docs, text_col)))
    kept = marked.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__node")))
    return kept.dropDuplicates(["__id", "__node"]).select(*docs.columns)
