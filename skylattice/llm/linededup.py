"""Line dedup, in DataFrame operations only: a suffix array over line ids by distributed prefix doubling.

Lines are 64-bit ids. Ranks of suffixes by their first 1, 2, 4, ... lines come from ranks of half the
length, as in prefix doubling: within a rank, suffixes are ordered by the rank of what follows. The
suffixes that share their first n lines are an interval of the suffix array whose longest common prefix
is at least n, named by two overlapping ranks of a power of two. A run of lines is repeated if such an
interval holds it more than once; the earliest stays, the later ones are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, running, text_of
from .mixing import word_count

#: Least words of a repeated run that is deleted.
MIN_WORDS = 50
#: Followers' ranks of a span, within which one task orders those of a rank.
SPAN_BITS = 8
def _numbered(docs: DataFrame, text: Column) -> DataFrame:
    """(doc_id, th, d, lines): a number d of each document that rises with doc_id, and its lines that have words.

    A line is (at, id, w): its place in the text, its id, its words.
    """
    parts = F.split(text, "\n", -1)
    lines = F.transform(parts, lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("id"), word_count(x).cast("int").alias("w")))
    base = docs.select("doc_id", F.xxhash64(text).alias("th"), F.filter(lines, lambda x: x["w"] > 0).alias("lines"))
    base = base.dropDuplicates(["doc_id", "th"]).orderBy(F.col("doc_id").asc_nulls_last(), "th").withColumn("n", F.monotonically_increasing_id())
    return cut(base.select("doc_id", "th", F.col("n").alias("d"), "lines"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, text_col: str = "text") -> DataFrame:
    """(doc_id, th, removed): of each document that has any, the places of the lines that repeat an earlier run.

    `th` is xxhash64 of the text. See `dedup_lines` for what counts as a repeated run.
    """
    text = text_of(docs, text_col)
    base = _numbered(docs, text)
    lines = base.select("d", F.posexplode("lines").alias("i", "x")).select("d", "i", "x.at", "x.id", "x.w")
    counts = cut(lines.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"))
    # Rank by one line: how many repeated lines have a lesser id.
    ranks = running(counts.withColumn("b", F.shiftright("id", 52)), [], "b", [F.col("id")], F.col("n"), "r0").select("id", F.col("r0").cast("long").alias("r0"))
    a = lines.join(cut(ranks), "id").select("d", "i", "at", "w", "r0")
    # Stretches of repeated lines; only one of min_words words or more can hold a run to delete.
    by_doc = Window.partitionBy("d").orderBy("i")
    a = a.withColumn("stretch", F.col("i") - F.row_number().over(by_doc))
    stretch = Window.partitionBy("d", "stretch").orderBy("i")
    a = a.withColumn("end", F.sum("w").over(stretch.rowsBetween(Window.unboundedPreceding, 0)))
    a = a.withColumn("start", F.col("end") - F.col("w"))
    a = a.withColumn("words", F.max("end").over(Window.partitionBy("d", "stretch"))).where(F.col("words") >= min_words)
    # Least runs of min_words words: the one that starts with a line, and the one that ends with it.
    on = Window.partitionBy("d", "stretch").orderBy("start").rangeBetween(0, min_words - 1)
    back = Window.partitionBy("d", "stretch").orderBy("end").rangeBetween(-(min_words - 1), 0)
    a = a.withColumn("ahead", F.when(F.max("end").over(on) - F.col("start") >= min_words, F.count("*").over(on)))
    a = a.withColumn("behind", F.when(F.col("end") - F.min("start").over(back) >= min_words, F.count("*").over(back)))
    a = cut(a.select("d", "i", "at", "r0", "ahead", "behind"))
    longest = a.agg(F.max(F.greatest("ahead", "behind"))).first()[0] or 1
    level = 0
    while 2 << level <= longest:
        a = _doubled(a, level)
        level += 1
    runs = a.where("ahead is not null").select("d", "i", F.col("ahead").cast("int").alias("n"))
    runs = runs.unionByName(a.where("behind is not null").select("d", (F.col("i") - F.col("behind") + 1).cast("int").alias("i"), F.col("behind").cast("int").alias("n"))).distinct()
    # The interval of a run: ranks of the greatest power of two at its start and flush with its end.
    runs = runs.withColumn("k", F.floor(F.log2("n")).cast("int"))
    rank = F.array(*[F.col(f"r{k}") for k in range(level + 1)])
    table = a.select("d", "i", rank.alias("ranks"))
    runs = runs.join(table, ["d", "i"]).withColumn("first", F.element_at("ranks", F.col("k") + 1)).drop("ranks")
    runs = runs.withColumn("j", (F.col("i") + F.col("n") - F.expr("shiftleft(1, k)")).cast("int"))
    runs = runs.join(table.withColumnRenamed("i", "j"), ["d", "j"]).withColumn("last", F.element_at("ranks", F.col("k") + 1))
    runs = cut(runs.select("d", "i", "n", "first", "last"))
    key = ["n", "first", "last"]
    origin = cut(runs.groupBy(*key).agg(F.min(F.struct("d", "i")).alias("origin"), F.count("*").alias("copies")).where("copies > 1"))
    later = runs.join(origin, key).where(F.struct("d", "i") > F.col("origin"))
    gone = later.select("d", F.explode(F.sequence(F.col("i"), F.col("i") + F.col("n") - 1)).alias("i")).distinct()
    gone = gone.join(a.select("d", "i", "at"), ["d", "i"]).groupBy("d").agg(F.sort_array(F.collect_list("at")).alias("removed"))
    return base.select("doc_id", "th", "d").join(gone, "d").select("doc_id", "th", "removed")


def _doubled(a: DataFrame, level: int) -> DataFrame:
    """`a` with the ranks by 2^(level + 1) lines, from those by 2^level.

    What has no such follower comes first in its rank. Distinct pairs of ranks are counted first, and a
    rank with many followers is ordered in spans of 2^SPAN_BITS of them, each a task's.
    """
    r, new, step = f"r{level}", f"r{level + 1}", 1 << level
    by_doc = Window.partitionBy("d").orderBy("i")
    follows = F.lead("i", step).over(by_doc) == F.col("i") + step
    a = cut(a.withColumn("next", F.when(follows, F.lead(r, step).over(by_doc)).otherwise(F.lit(-1)).cast("long")))
    pairs = a.groupBy(r, "next").agg(F.count("*").alias("n")).withColumn("b", F.shiftright("next", SPAN_BITS))
    pairs = running(pairs, [r], "b", [F.col("next")], F.col("n"), "before")
    pairs = cut(pairs.select(r, "next", (F.col(r) + F.col("before")).cast("long").alias(new)))
    return cut(a.join(pairs, [r, "next"]).drop("next"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, text_col: str = "text") -> DataFrame:
    """`docs` with n_lines, n_removed, and the text without runs of lines that repeat an earlier run.

    Documents are in the order of doc_id (null last), lines of a document in their own. A run is a row of
    consecutive lines of one document, lines without words passed over; it is deleted if it has at least
    `min_words` words and the same lines, in a row, start earlier in the corpus, be it in the same
    document. So all copies of a passage but the first go, and so do all but the first of equal lines
    of that size; shorter repeats and their neighbours stay, as do blank lines.

    Null texts are empty and stay null. Rows of equal doc_id and text are one document and are edited
    alike. Extra columns are kept; n_lines and n_removed replace columns so named. No row is dropped; a
    document of which nothing is left has an empty text. An empty table stays empty.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs = docs.select(*keep)
    removed = cut(repeated_lines(docs, min_words, text_col))
    # A flag for each line up to the last that goes, so that a line is judged without a search.
    stays = F.transform("removed", lambda x, k: F.concat(F.array_repeat(F.lit(True), (x - F.coalesce(F.get("removed", k - 1), F.lit(-1)) - 1).cast("int")), F.array(F.lit(False))))
    removed = removed.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.flatten(stays).alias("__stays"), F.size("removed").cast("long").alias("__n"))
    text = text_of(docs, text_col)
    out = docs.withColumn("__h", F.xxhash64(text)).join(removed, (F.col("__h") == F.col("__th")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: F.coalesce(F.get("__stays", i), F.lit(True))), "\n")
    out = out.withColumn("n_lines", F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).cast("long"))
    out = out.withColumn("n_removed", F.coalesce("__n", F.lit(0).cast("long")))
    return out.withColumn(text_col, F.when(F.col("__n").isNull(), F.col(text_col)).otherwise(left)).select(*keep, "n_lines", "n_removed")
