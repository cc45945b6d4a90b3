"""Ranked lexical search, term and document at a time in one: short lists are summed, long ones skipped over.

Documents are tokenised once; of each, the query set's terms and their counts are kept as postings. A task then searches
its own documents, block by block, for every query. Of a query's lists the short ones are added up term at a time into
accumulators; these become one more iterator, whose bound is the greatest sum. Document at a time, in windows of documents,
the iterators are merged: those whose bounds together can't lift a document to the last rank held give no candidates and
are only probed, greatest bound first, for candidates that can still get there. Tasks return their best documents, which
meet by query.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import cut, dropped, slices, small_batches, written

#: Documents, and postings, of a block; documents of a window.
BLOCK_DOCS, BLOCK_POSTINGS, WINDOW = 1 << 14, 1 << 21, 1 << 12
#: Short lists hold together at most this share of a block's documents.
SHORT_SHARE = 0.25
#: Distinct terms, and queries, searched in one pass: bounds what is broadcast. More queries take more passes.
CHUNK_TERMS, CHUNK_QUERIES = 1 << 17, 1 << 12
#: Parts in which a query's results from all tasks are cut down before they meet.
SALTS = 64

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all characters beyond ASCII; only A-Z are lowered."""
    return _TERM.findall(text.encode().lower()) if text else []


def chunks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[list[int]], dict[bytes, int]]]:
    """(ids, each query's term numbers, terms) of bounded groups of queries, streamed through the driver."""
    ids, lists, vocabulary = [], [], {}
    for row in queries.select(id_col, text_col).toLocalIterator():
        if len(ids) >= CHUNK_QUERIES or len(vocabulary) >= CHUNK_TERMS:
            yield ids, lists, vocabulary
            ids, lists, vocabulary = [], [], {}
        ids.append(row[0])
        lists.append([vocabulary.setdefault(x, len(vocabulary)) for x in sorted(set(terms_of(row[1])))])
    if ids:
        yield ids, lists, vocabulary


def postings(docs: DataFrame, vocabulary: dict[bytes, int], text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) of every document that has terms: their number with repeats, and those in the vocabulary."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    of = {"terms": pa.list_(pa.int32()), "tfs": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            for part in slices(batch, "text"):
                ids, lengths, terms, tfs = [], [], [], []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    found = terms_of(text)
                    if found:
                        counts = {t: n for x, n in Counter(found).items() if (t := number(x)) is not None}
                        ids.append(doc)
                        lengths.append(len(found))
                        terms.append(list(counts))
                        tfs.append(list(counts.values()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(terms, of["terms"]), pa.array(tfs, of["tfs"])], names=["doc_id", "n", "terms", "tfs"])

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return source.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Block:
    """The inverted lists of some documents: per term, documents in order, what each adds per unit of weight, and the most."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, total: int, length: int) -> None:
        self.ids, self.size = ids, len(ids)
        m = 50 + (50 * n * total) // length
        docs = np.repeat(np.arange(self.size), sizes)
        order = np.argsort(terms, kind="stable")
        self.docs = docs[order]
        tf = tfs[order].astype(np.int64)
        self.gain = (1_000_000_000 * tf) // (1000 * tf + 20 * m[self.docs])
        sorted_terms = terms[order]
        starts = np.flatnonzero(np.concatenate([[True], sorted_terms[1:] != sorted_terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(terms))
        most = np.maximum.reduceat(self.gain, starts) if len(starts) else starts
        self.lists = {int(sorted_terms[a]): (int(a), int(b), int(c)) for a, b, c in zip(starts, ends, most)}


class Best:
    """The k best (score, document) so far; `last` is the least score that may still enter, ties included."""

    def __init__(self, k: int) -> None:
        self.k, self.last = k, 1
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        keep = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[keep], ids[keep]
        if len(keep) == self.k:
            self.last = max(1, int(self.scores[-1]))


def search_block(block: Block, terms: list[int], weight: np.ndarray, best: Best, window: int, share: float) -> None:
    """Adds to `best` every document of the block that belongs there."""
    lists = sorted((block.lists[t][1] - block.lists[t][0], t) for t in terms if t in block.lists and weight[t] > 0)
    room, short = share * block.size, 0
    while short < len(lists) and (room := room - lists[short][0]) >= 0:
        short += 1
    iterators = []  # (bound, documents, scores)
    for _, t in lists[short:]:
        a, b, most = block.lists[t]
        iterators.append((most * int(weight[t]), block.docs[a:b], block.gain[a:b], int(weight[t])))
    if short:  # term at a time
        total = np.zeros(block.size, np.int64)
        for _, t in lists[:short]:
            a, b, _ = block.lists[t]
            total[block.docs[a:b]] += block.gain[a:b] * int(weight[t])
        held = np.flatnonzero(total)
        iterators.append((int(total[held].max()), held, total[held], 1))
    iterators.sort(key=lambda x: x[0])
    below = [0]
    for x in iterators:
        below.append(below[-1] + x[0])
    for lo in range(0, block.size, window):  # document at a time
        hi = min(lo + window, block.size)
        first = next((i for i in range(len(iterators)) if below[i + 1] >= best.last), len(iterators))
        if first == len(iterators):
            return
        sums = np.zeros(hi - lo, np.int64)
        for _, docs, gain, w in iterators[first:]:
            a, b = np.searchsorted(docs, (lo, hi))
            sums[docs[a:b] - lo] += gain[a:b] * w
        found = np.flatnonzero(sums)
        score = sums[found]
        found += lo
        for i in range(first - 1, -1, -1):
            keep = score + below[i + 1] >= best.last
            found, score = found[keep], score[keep]
            if not len(found):
                break
            _, docs, gain, w = iterators[i]
            at = np.searchsorted(docs, found)
            hit = at < len(docs)
            hit[hit] = docs[at[hit]] == found[hit]
            score[hit] += gain[at[hit]] * w
        keep = score >= best.last
        if keep.any():
            best.add(score[keep], block.ids[found[keep]])


def best_of_tasks(lists: DataFrame, queries: list[list[int]], weight: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    """(query, doc_id, score): of each task, the k best of its documents for each query."""
    spark = lists.sparkSession
    shared = spark.sparkContext.broadcast((queries, weight))
    window, share = WINDOW, SHORT_SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights = shared.value
        best = [Best(k) for _ in wanted]
        held: list[pa.RecordBatch] = []
        docs = n_postings = 0

        def search() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            ids = np.asarray(t.column("doc_id").fill_null(np.iinfo(np.int64).max))
            sizes = np.diff(np.asarray(t.column("terms").chunk(0).offsets))
            block = Block(ids, np.asarray(t.column("n")), sizes, np.asarray(t.column("terms").chunk(0).flatten()), np.asarray(t.column("tfs").chunk(0).flatten()), total, length)
            for q, terms in enumerate(wanted):
                search_block(block, terms, weights, best[q], window, share)

        for batch in batches:
            if not batch.num_rows:
                continue
            if held and (docs + batch.num_rows > BLOCK_DOCS or n_postings > BLOCK_POSTINGS):
                search()
                held, docs, n_postings = [], 0, 0
            held.append(batch)
            docs += batch.num_rows
            n_postings += len(batch.column("terms").flatten())
        if held:
            search()
        for a in range(0, len(best), 256):
            part = best[a : a + 256]
            query = np.repeat(np.arange(a, a + len(part)), [len(b.ids) for b in part])
            ids = np.concatenate([b.ids for b in part])
            yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(ids, mask=ids == np.iinfo(np.int64).max), pa.array(np.concatenate([b.scores for b in part]))], names=["query", "doc_id", "score"])

    return lists.mapInArrow(run, "query int, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """The k documents that score highest for each query: `id_col`, rank (from 1), doc_id, score; only scores above 0.

    `docs` has doc_id and text, other columns are ignored; null and empty texts have no term. Equal scores go by ascending
    doc_id, null last; rows of one doc_id are documents of their own. Every row of `queries` is a query, so rows of one id
    are ranked apart. A query without terms, an empty table and terms that no document holds give no row.
    """
    spark = docs.sparkSession
    kind = queries.schema[id_col].dataType
    out = spark.createDataFrame([], f"`{id_col}` {kind.simpleString()}, rank int, doc_id long, score long")
    for ids, wanted, vocabulary in chunks(queries, id_col, query_col):
        lists = written(postings(docs, vocabulary), "postings")
        total, length = lists.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not total:
            continue
        weight = np.zeros(len(vocabulary), np.int64)
        for t, df in lists.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():
            weight[t] = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
        found = best_of_tasks(lists, wanted, weight, total, length, k)
        order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        # A query has k rows from every task: they are cut down in parts first.
        parts = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        for keys in (["query", "part"], ["query"]):
            parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([Row(query=i, name=x) for i, x in enumerate(ids)], f"query int, name {kind.simpleString()}")
        ranked = parts.join(F.broadcast(names), "query").select(F.col("name").alias(id_col), "rank", "doc_id", "score")
        out = out.unionByName(cut(ranked))  # k rows a query; the postings are not needed after that
        dropped(lists)
    return out
