"""Document fingerprints by randomised edit embedding: one random walk over characters, shared by all documents.

At step j the walk emits the character it stands on and moves on if a random bit, fixed by (j, character),
says so. Two texts that differ by few edits fall into step again soon after each, so their emitted strings
differ in few places: edit distance has become Hamming distance, which sampled places estimate.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import add_columns, cut, dropped, freeing, small_batches, text_of, written
from .links import linked

#: Slots of a fingerprint, emitted characters each covers, and the seed of walks and samples.
SLOTS, SPAN, SEED = 128, 4, 11
#: Code points walked side by side, at most (a longer text is walked alone).
BLOCK_CHARS = 5 << 20
STEPS = 4096  # rows of random bits made at once
END = 255  # class of what follows a text's last character; never moved on from


@functools.lru_cache(maxsize=64)
def moves(block: int) -> np.ndarray:
    """Random bits of STEPS steps by character class; row r is step block * STEPS + r. The end never moves."""
    rng = np.random.Generator(np.random.Philox(key=[SEED, block]))
    bits = rng.integers(0, 2, (STEPS, 256), dtype=np.uint8)
    bits[:, END] = 0
    return bits


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer of whole arrays."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Samples:
    """Where each slot looks: for a text of n characters, the step before 2n with the least hash.

    The place moves only when a longer range holds a lesser hash, so texts of about equal length look at
    the same steps. `record[s]` has the steps at which slot s's least hash falls, in order.
    """

    def __init__(self) -> None:
        self.upto = 0
        self.least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
        self.record: list[list[int]] = [[] for _ in range(SLOTS)]

    def cover(self, steps: int) -> None:
        while self.upto < steps:
            at = np.arange(self.upto, self.upto + STEPS, dtype=np.uint64)
            for s in range(SLOTS):
                h = mixed(at + np.uint64((SEED * SLOTS + s) << 40))
                low = np.minimum.accumulate(np.concatenate([self.least[s : s + 1], h]))
                self.record[s] += (self.upto + np.flatnonzero(low[1:] < low[:-1])).tolist()
                self.least[s] = low[-1]
            self.upto += STEPS

    def steps(self, n: np.ndarray) -> np.ndarray:
        """texts x slots: the step each slot looks at, for texts of n characters."""
        top = np.maximum(2 * n, 1)
        self.cover(int(top.max(initial=1)))
        return np.stack([np.array(r)[np.searchsorted(r, top, "left") - 1] for r in self.record], axis=1)


_SAMPLES = Samples()


def walk(classes: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """texts x slots of uint16: what each text's walk shows at its sampled steps.

    `classes` holds the texts one after another, each followed by END; text i starts at first[i]. All
    walks go side by side, longest first, and those past their last sampled step drop out.
    """
    order = np.argsort(-n, kind="stable")
    steps = _SAMPLES.steps(n[order])
    wanted = np.unique(steps)
    need = steps.max(axis=1) + SPAN  # rows sorted by length need not be sorted by this
    until = np.maximum.accumulate(need[::-1])[::-1]
    at = first[order].astype(np.int64)
    shown: dict[int, np.ndarray] = {}
    record = np.zeros(int(until.max(initial=0)) + SPAN + 1, bool)
    for k in range(SPAN):
        record[np.minimum(wanted + k, len(record) - 1)] = True
    step, active, flat = 0, len(at), classes
    seen = np.empty(len(at), np.uint8)
    hop = np.empty(len(at), np.uint8)
    total = int(until.max(initial=0))
    while step < total:
        bits = moves(step // STEPS)
        stop = min(total, (step // STEPS + 1) * STEPS)
        active = int(np.searchsorted(-until, -step, "left"))
        here, see, go = at[:active], seen[:active], hop[:active]
        for j in range(step, stop):
            np.take(flat, here, out=see, mode="clip")
            if record[j]:
                shown[j] = see.copy()
            np.take(bits[j % STEPS], see, out=go, mode="clip")
            np.add(here, go, out=here)
            if not j & 255:
                now = int(np.searchsorted(-until, -j, "left"))
                if now < active:
                    active = now
                    here, see, go = at[:active], seen[:active], hop[:active]
        step = stop
    value = mixed(steps.astype(np.uint64) + np.uint64(SEED << 48))
    with np.errstate(over="ignore"):
        for k in range(SPAN):
            value = mixed(value * np.uint64(31) + _gather(shown, steps + k))
    out = np.empty(steps.shape, np.uint16)
    out[order] = (value >> np.uint64(48)).astype(np.uint16)
    return out


def _gather(shown: dict[int, np.ndarray], steps: np.ndarray) -> np.ndarray:
    """The class that row i showed at steps[i, s]; END where its walk was over."""
    flat = steps.ravel()
    by = np.argsort(flat, kind="stable")
    rows = np.arange(len(flat)) // steps.shape[1]
    out = np.full(len(flat), END, np.uint64)
    value, begin = np.unique(flat[by], return_index=True)
    for v, a, b in zip(value.tolist(), begin, [*begin[1:], len(by)], strict=True):
        got = shown.get(v)
        if got is not None:
            own = by[a:b]
            who = rows[own]
            fine = who < len(got)
            out[own[fine]] = got[who[fine]]
    return out.reshape(steps.shape)


def fingerprints(texts: Sequence[str]) -> np.ndarray:
    """texts x SLOTS of uint16. An empty text's walk shows the end everywhere."""
    n = np.array([len(x) for x in texts], np.int64)
    joined = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    with np.errstate(over="ignore"):
        classes = ((joined * np.uint32(0x9E3779B1)) >> np.uint32(8)) % np.uint32(END)
    classes = classes.astype(np.uint8)
    first = np.concatenate([[0], np.cumsum(n + 1)[:-1]])
    classes[first + n] = END
    return walk(classes, first, n)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of slots in which rows agree, 0 to 1."""
    return (a == b).mean(axis=-1)


def hexed(prints: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in prints]


PRINTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def fingerprint(df: DataFrame, column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`df` with fingerprint string, hexadecimal, of each whole text; null is empty, columns of that name are replaced."""
    new = T.StructType([T.StructField("fingerprint", T.StringType())])
    return add_columns(df, column, new, lambda texts: (hexed(fingerprints([x or "" for x in texts])),), keep, limit=BLOCK_CHARS)


def spliced(text: str, following: str) -> str:
    """`text` with its last floor(n / 2) code points replaced by the first as many, or all, of `following`."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, carried, key, doc_id, text): ranges of descending ids as buckets, each ended by the row that follows it.

    Bucket bounds are quantiles of the ids. The rows with the greatest id of a bucket go to the bucket
    above too, as `carried`, and those of the top bucket to the lowest, so that every row finds its next
    one in its own bucket. A null id comes last; rows of equal ids follow each other by text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"), F.col(id_col).cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    keys = rows.select(F.col("key").cast("double").alias("k"))
    n = max(1, 3 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(keys.approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    place: Column = F.lit(0)
    if bounds:
        place = F.expr(f"cast({_search('cast(key as double)', bounds)} as int)")
    rows = rows.withColumn("bucket", place)
    heads = [(r.bucket, r.head) for r in rows.groupBy("bucket").agg(F.max("key").alias("head")).orderBy("bucket").collect()]  # a row a bucket
    if not heads:
        return rows.select("bucket", F.lit(0).alias("carried"), "key", "doc_id", "text")
    above = [b for b, _ in heads[1:]] + [heads[0][0]]
    small = spark.createDataFrame([(b, h, to) for (b, h), to in zip(heads, above, strict=True)], "hb int, head long, to int")
    joined = rows.join(F.broadcast(small), (F.col("bucket") == F.col("hb")) & (F.col("key") == F.col("head")), "left")
    copies = F.when(F.col("to").isNull(), F.array(F.struct(F.col("bucket"), F.lit(0).alias("carried")))).otherwise(
        F.array(F.struct(F.col("bucket"), F.lit(0).alias("carried")), F.struct(F.col("to").alias("bucket"), F.lit(1).alias("carried")))
    )
    return joined.select(F.explode(copies).alias("c"), "key", "doc_id", "text").select("c.bucket", "c.carried", "key", "doc_id", "text")


def _search(value: str, bounds: list[float]) -> str:
    """SQL of the number of bounds <= value, as a binary tree of CASEs."""

    def tree(a: int, b: int) -> str:
        if a == b:
            return str(a)
        m = (a + b) // 2
        return f"CASE WHEN {value} < {bounds[m]!r}D THEN {tree(a, m)} ELSE {tree(m + 1, b)} END"

    return tree(0, len(bounds))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text (`spliced` with the next document's), and their likeness.

    The next document is the one of the next lower id; the first follows the last. Texts are dealt once,
    by ranges of ids, sorted and streamed; about BLOCK_CHARS are held at a time. Null texts are empty,
    a table of one row follows itself, other columns are ignored, an empty table gives no row.
    """
    small_batches(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = in_order(docs, id_col, text_col)
    rows = rows.repartition(n, "bucket").sortWithinPartitions("bucket", "carried", F.col("key").desc(), "text")
    rows = rows.select("bucket", "carried", "doc_id", "text")
    arrow = to_arrow_schema(PRINTS)

    def measured(held: list[tuple]) -> pa.RecordBatch:
        """`held`: (doc_id, text, next text)."""
        texts = [x[1] for x in held]
        edited = [spliced(x[1], x[2]) for x in held]
        # Nearly every next text is the next row's own.
        strange = [i for i, x in enumerate(held) if i + 1 == len(held) or held[i + 1][1] is not x[2]]
        prints = fingerprints([*texts, *edited, *(held[i][2] for i in strange)])
        own, new, rest = np.split(prints, [len(held), 2 * len(held)])
        following = np.roll(own, -1, axis=0)
        following[strange] = rest
        sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited]
        columns = [[x[0] for x in held], [len(x) for x in texts], sha, hexed(own), hexed(new), likeness(own, new), likeness(own, following)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        chars, here, last = 0, None, None  # last: the row that waits for its next
        for batch in batches:
            for bucket, carried, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket != here:
                    here, last = bucket, None
                if last is not None:
                    held.append((*last, text))
                    chars += 2 * len(last[1])
                last = None if carried else (doc_id, text)
                if chars >= BLOCK_CHARS:
                    yield measured(held)
                    held, chars = [], 0
        if held:
            yield measured(held)

    return rows.mapInArrow(run, PRINTS)


#: Slots of a band, and the least share of equal slots of near texts.
BAND, NEAR = 3, 0.5
BANDS = SLOTS // BAND
#: Bands whose buckets are looked up at once.
PASS = 14
#: Hexadecimal columns, which are moved as the bytes they stand for.
HEXED = ("edited_sha256", "fingerprint", "edited_fingerprint")


def _alike(prints: list[np.ndarray], side: np.ndarray | None, label: np.ndarray | None) -> list[tuple[int, int]]:
    """Pairs of fingerprints that agree in NEAR of their slots and join two classes."""
    rows = np.stack(prints)
    klass = np.arange(len(rows)) if label is None else np.unique(label, return_inverse=True)[1]
    out = []
    for i in range(len(rows) - 1):
        j = np.flatnonzero(klass[i + 1 :] != klass[i]) + i + 1
        if side is not None:
            j = j[side[j] != side[i]]
        for k in j[likeness(rows[i], rows[j]) >= NEAR].tolist():
            if klass[k] != klass[i]:
                klass[klass == klass[k]] = klass[i]
                out.append((i, k))
    return out


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id: `classed` over the fingerprints of `docs`. Null texts are empty; other columns are ignored."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    base = base.withColumn("n_chars", F.char_length("text").cast("long"))
    prints = written(fingerprint(base, "text", ["doc_id", "n_chars"]), "prints", free=True)
    return classed(prints).select("doc_id", "class_id")


def classed(prints: DataFrame) -> DataFrame:
    """`prints`, a stored table with doc_id, n_chars and fingerprint, with class_id: the least doc_id of the row's class.

    Texts whose fingerprints agree in at least NEAR of their slots are in one class. Bands of BAND slots,
    which sample the embedded strings at the same places, make the candidates: a pair at the threshold
    shares none of the 42 bands, and is missed, with probability (1 - 0.5^3)^42, about 4 in 1,000, and one
    at 0.7 with 4 in 100 million. Every pair of a band is verified on whole fingerprints, or in one class
    already: the blocks of the first PASS bands are linked first, and then, of all bands, the buckets that
    still hold several classes. Buckets are looked up PASS bands at a time, so that what lies in shuffle
    files doesn't grow with the bands. Equal fingerprints are one node from the start, however many; empty texts link to
    no other text. Null ids are kept, in a class whose least id is null only if all its ids are; an empty
    table gives no row.
    """
    packed = [c for c in HEXED if c in prints.columns]
    rows = prints.withColumns({c: F.unhex(c) for c in packed}).withColumn("__node", F.xxhash64(F.col("n_chars") > 0, "fingerprint"))
    nodes = rows.groupBy(F.col("__node").alias("node")).agg(F.min("doc_id").alias("first"), F.max("n_chars").alias("n"), F.any_value("fingerprint").alias("text"))
    nodes = written(nodes, "nodes", free=True)
    scratch = [nodes]

    def kept(df: DataFrame) -> DataFrame:
        scratch.append(written(df, "links", free=True))
        return scratch[-1]

    full = nodes.where("n > 0").select("node", "text")
    width = 2 * BAND
    bands = [F.xxhash64(F.lit(i), F.substring("text", i * width + 1, width)) for i in range(BANDS)]

    def joined(shared: DataFrame, **how: object) -> DataFrame:
        members = shared.select("node", F.array("bucket").alias("keys"), F.lit(1).cast("long").alias("size"))
        return linked(members, lambda places: full.join(places, "node"), lambda x: np.frombuffer(x, np.uint16), _alike, kept, **how)

    with freeing(prints.sparkSession):
        labels = joined(kept(_mixed_buckets(full, bands[:PASS], None)), across=False)
        found = [kept(_mixed_buckets(full, bands[i : i + PASS], labels)) for i in range(0, BANDS, PASS)]
        labels = joined(functools.reduce(DataFrame.unionByName, found), start=labels)
        named = nodes.select("node", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        heads = named.groupBy("label").agg(F.min("first").alias("class_id"))
        named = cut(named.join(heads, "label").select(F.col("node").alias("__node"), "class_id"))
    for x in scratch:
        dropped(x)
    return rows.join(named, "__node").drop("__node").withColumns({c: F.lower(F.hex(c)) for c in packed})


def _mixed_buckets(nodes: DataFrame, bands: list[Column], labels: DataFrame | None) -> DataFrame:
    """(node, bucket) of the members of buckets that hold nodes of several classes; without `labels` each node is one."""
    keyed = nodes.select("node", F.array(*bands).alias("keys"))
    if labels is not None:
        keyed = keyed.join(labels, "node", "left")
    label = F.coalesce("label", "node") if labels is not None else F.col("node")
    member = keyed.select("node", label.alias("label"), F.explode("keys").alias("bucket"))
    mixed = member.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most")
    return member.join(mixed.select("bucket"), "bucket").select("node", "bucket")
