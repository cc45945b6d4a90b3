"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, running

#: Sources whose rows, one each, are broadcast; with more the join is dealt.
FEW = 10_000
#: Characters that separate words: space and \\x09-\\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words in a text; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.05 to 1.05: the share of a text's characters that are neither upper-case A-Z, digits nor `#$%&*|!`."""
    n = F.length(text)
    odd = F.regexp_count(text, F.lit(r"[A-Z0-9#$%&*|!]"))
    return F.coalesce(F.lit(0.05) + (n - odd) / F.when(n > 0, n), F.lit(0.05))


def uniform_of(key: Column) -> Column:
    """A number in (0, 1) fixed by a string key: the first 48 bits of its MD5."""
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target of each source, from one row (source, source_size) a source.

    Sources by code point, null last, weigh `weights`, repeating, and share `share` times the sum of
    sizes. No target passes `cap` times its source's size: what is above goes to the others by weight,
    again and again. That is one level L with target = min(cap * size, L * weight), found by running
    sums over sources in the order in which they reach their caps; a source without words gets 0.
    Works on a row a source only. A share that all caps together can't hold leaves all at their caps.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    s = sizes.withColumn("__w", weight).withColumn("__full", F.lit(float(cap)) * F.col("source_size"))
    reach = Window.orderBy(F.col("__full") / F.col("__w"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    s = (
        s.withColumn("__below", F.coalesce(F.sum("__full").over(reach.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("__above", F.sum("__w").over(reach.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("__budget", F.lit(float(share)) * F.sum("source_size").over(all_rows))
        .withColumn("__level", (F.col("__budget") - F.col("__below")) / F.col("__above"))
    )
    open_level = F.max(F.when(F.col("__level") * F.col("__w") <= F.col("__full"), F.col("__level"))).over(all_rows)
    target = F.when(open_level.isNull(), F.col("__full")).otherwise(F.least(F.col("__full"), open_level * F.col("__w")))
    return s.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    weight: Callable[[Column], Column] = quality_weight,
    text_col: str = "text",
    seed: str = "mix",
    rows_per_bucket: int = 1_000,
) -> DataFrame:
    """`docs` with size, source_size, target, copies, taken: how often the mix takes each document.

    A source's target is spent on whole epochs first: `floor(target / source_size)` copies of every
    document. The rest goes to documents in the order of Efraimidis-Spirakis keys, -ln(u) / weight
    ascending, where u in (0, 1) is fixed by `seed`, doc_id and text; their sizes are summed until the
    rest is reached. The document that crosses it is taken if that ends nearer to the target. All the
    sums leave behind is the last key taken in each source, with which the rows of `docs` are compared.

    Null text has size 0 and the least weight; a document of size 0 costs nothing and follows the same
    order; null sources are a source; rows of equal doc_id and text are taken or left together; an
    empty table gives none. Columns of `docs` named as one of the results are replaced. A hot source is
    spread over key buckets (`running`) of about `rows_per_bucket` rows.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    keep = [c for c in docs.columns if c not in made]
    text = F.coalesce(F.col(text_col), F.lit(""))
    u = uniform_of(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text)))
    keyed = docs.select(*keep, word_count(text).alias("size"), F.struct((-F.log(u) / weight(text)).alias("key"), "doc_id", F.xxhash64(text).alias("th")).alias("__key"))
    narrow = cut(keyed.select("doc_id", "source", "size", F.col("__key.key").alias("key"), F.col("__key.th").alias("th")))
    by_source = cut(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    n_sources, most = by_source.agg(F.count("*"), F.max("rows")).first()
    targets = source_targets(by_source.select("source", "source_size"), weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("__epochs", epochs).withColumn("__rest", F.col("target") - F.col("__epochs") * F.col("source_size"))
    targets = cut(targets.withColumnRenamed("source", "__source"))
    small = F.broadcast if n_sources <= FEW else (lambda x: x)
    same = F.col("source").eqNullSafe(F.col("__source"))
    # One bucket count serves all sources; a key's bucket rises with the key.
    n = max(1, -(-(most or 1) // rows_per_bucket))
    spread = F.least(F.lit(n - 1), F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * n)).cast("int")
    ranked = running(narrow.withColumn("bucket", spread), ["source"], "bucket", [F.col("key"), F.col("doc_id"), F.col("th")], F.col("size"), "before")
    ranked = ranked.join(small(targets.select("__source", "__rest")), same)
    over = F.col("before") + F.col("size") - F.col("__rest")
    chosen = (over <= 0) | ((F.col("before") < F.col("__rest")) & (over < F.col("__rest") - F.col("before")))
    last = ranked.where(chosen & (F.col("__rest") > 0)).groupBy("__source").agg(F.max(F.struct("key", "doc_id", "th")).alias("__last"))
    targets = cut(targets.join(last.withColumnRenamed("__source", "__s"), F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s", "__rest"))
    full = narrow.select("doc_id", "source", "size", F.struct("key", "doc_id", "th").alias("__key")) if set(keep) <= {"doc_id", "source"} else keyed
    out = full.join(small(targets), same)
    copies = (F.col("__epochs") + F.when(F.col("__key") <= F.col("__last"), 1).otherwise(0)).cast("long")
    return out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select(*keep, *made)


def mixed(docs: DataFrame, **how: object) -> DataFrame:
    """The rows of `docs`, each as often as `mix` takes it."""
    taken = mix(docs, **how)
    return taken.withColumn("__no", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(*docs.columns)
