"""Byte-level BPE as DataFrame expressions: ranked merges folded over the bytes of words by higher-order functions.

The rank map is one row of the vocabulary: a pair of neighbouring tokens finds the rank of what they make. Spark's map
lookup reads a map from end to end, so the map is dealt by a hash of its key into an array of small maps. It reaches the
expressions as a scalar, that is a literal of the plan, and no document is ever shuffled: a text is split into words,
each word is looked up among the distinct words that were folded once, and what is not there is folded in its row.
"""

from __future__ import annotations

import base64
import functools
import sys
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import LETTERS_16, NUMBERS_16
from .common import cut

#: Lists the rank map is dealt into, and lists of the words folded once; a power of two.
SLOTS = 1 << 18
#: Most words that are folded once, and the longest of them in bytes: bounds what goes to every task (some 40 MB).
WORDS, WORD_BYTES = 1 << 19, 48
#: The most frequent of those have a table of their own that stays in a core's cache, and the lists it is dealt into.
HOT, HOT_SLOTS = 1 << 12, 1 << 13
#: Rows that the frequent words are counted in, about. They only save work: a word that is not among them is folded in its row.
COUNTED_ROWS = 40_000
#: Longer words are cut where no token has the two bytes together, and what stays longer merges a pair at all its places at once.
SHORT = 64
#: What a pair that makes no token makes, above all letters; and what stands before and behind a word.
NONE, PAD = "\uffff", "\ufffe"
# The white space of the vocabulary's patterns.
SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def then(value: Column, state: Column, body: Callable[[Column], Column]) -> Column:
    """As `let` where the body has the type of `state`; Spark derives an aggregate's type once, an array element's at each use."""
    return F.aggregate(F.array(value), state, lambda _, x: body(x))


def ranks_of(path: str | None = None) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def classes(spark: SparkSession) -> tuple[str, str]:
    """Java character classes of the letters and the numbers of Unicode 16.0, whatever version the JVM has."""
    java = spark.sparkContext._jvm.java.util.regex.Pattern
    everything = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    out = []
    for name, newer in (("L", LETTERS_16), ("N", NUMBERS_16)):
        added = {chr(c) for a, b in newer for c in range(a, b + 1)}
        ours = {x for x in everything if unicodedata.category(x)[0] == name or x in added}
        lacks = java.compile(rf"\p{{{name}}}+").matcher("".join(sorted(ours))).replaceAll("")
        extra = java.compile(rf"[^\p{{{name}}}]+").matcher("".join(x for x in everything if x not in ours)).replaceAll("")
        shown = rf"\p{{{name}}}"
        if lacks:  # the first range spares common characters the walk over the others
            shown += rf"[\x{{{ord(lacks[0]):x}}}-\x{{10ffff}}&&[{spans(lacks)}]]"
        out.append(f"[{shown}]" if not extra else f"[[{shown}]&&[^{spans(extra)}]]")
    return out[0], out[1]


def spans(letters: str) -> str:
    runs: list[list[int]] = []
    for c in map(ord, letters):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs)


def words_of(text: Column, spark: SparkSession) -> Column:
    """The words of a text, as the vocabulary's pattern cuts it; null is empty."""
    letter, number = classes(spark)
    pattern = rf"'(?:s|t|re|ve|m|ll|d)| ?{letter}+| ?{number}+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def vocabulary_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """One row `t`: the letter of each byte's token, and which pairs of bytes some token has."""
    ranks = ranks_of(path)
    inside = [False] * 65536
    for token in ranks:
        for a, b in zip(token, token[1:]):
            inside[a << 8 | b] = True
    row = {"byte": [chr(ranks[bytes([i])]) for i in range(256)], "inside": inside}
    return spark.createDataFrame(pa.table({"t": pa.array([row], pa.struct([("byte", pa.list_(pa.string())), ("inside", pa.list_(pa.bool_()))]))}))


def last_pair(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What is merged last when a token's own bytes are merged; other than two where that doesn't make the token."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, i = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best == 1 << 30:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def rank_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The rank map: two tokens' letters, and the letter of what they make. A token's letter is the character whose code is its rank.

    Of the pairs that spell a token only the last of its own merges can arise: until a merge joins them to what is outside,
    bytes in a word are merged as if they stood alone.
    """
    ranks = ranks_of(path)
    if max(ranks.values()) >= 0xD800:
        raise ValueError("vocabularies of up to 55,296 tokens")
    pairs = {}
    for token, rank in ranks.items():
        if len(halves := last_pair(token, ranks)) == 2:
            pairs["".join(chr(ranks[x]) for x in halves)] = chr(rank)
    return word_table(spark.createDataFrame(pa.table({"word": list(pairs), "letters": list(pairs.values())})))


def token_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """One row `t`: the bytes of each token, as strings, which are read without a copy; a cast leaves the bytes as they are."""
    ranks = ranks_of(path)
    shown: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        shown[rank] = token
    return spark.createDataFrame(pa.table({"t": pa.array([shown], pa.list_(pa.binary()))})).select(F.col("t").cast("array<string>").alias("t"))


def word_table(words: DataFrame, slots: int = SLOTS) -> DataFrame:
    """One row `t`: (distinct word, letters) dealt by hash into an array of maps, null where nothing is: a lookup ends there, and only bits are read. For tables of a proven bound only."""
    dealt = words.groupBy(slot_of(F.col("word"), slots).alias("slot")).agg(F.collect_list(F.struct("word", "letters")).alias("in_slot"))
    every = words.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot")).join(dealt, "slot", "left")
    rows = every.agg(F.array_sort(F.collect_list(F.struct("slot", "in_slot"))).alias("rows"))
    return rows.select(F.transform("rows", lambda x: F.map_from_entries(x["in_slot"])).alias("t"))


def slot_of(word: Column, slots: int = SLOTS) -> Column:
    return F.hash(word).bitwiseAND(F.lit(slots - 1))


def found(table: Column, word: Column, slots: int = SLOTS) -> Column:
    return F.element_at(F.get(table, slot_of(word, slots)), word)


def made(t: Column, letters: Column, at: Column) -> Column:
    """The letter of what the tokens at `at` and behind it make, or NONE."""
    return F.coalesce(found(t["ranks"], F.substring(letters, at, F.lit(2))), F.lit(NONE))  # cut out twice, which costs less than a lambda


def neighbours(t: Column, letters: Column) -> Column:
    """For each token the letter of what it and the next make, or NONE."""
    return F.array_join(F.transform(F.split(letters, ""), lambda _, i: made(t, letters, i + 1)), "")


def least(near: Column) -> Column:
    return F.array_min(F.split(near, ""))


def fold(t: Column, letters: Column, steps: Column) -> Column:
    """Letters of a word's tokens after all merges: the least rank first, the leftmost of equal ones, one merge a step.

    `near` has what each token and the next would make. A pad at either end makes nothing with any token.
    """

    def state(letters: Column, near: Column) -> Column:
        return F.struct(letters.alias("letters"), near.alias("near"), least(near).alias("best"))

    def step(s: Column, _: Column) -> Column:
        letters, near, best = s["letters"], s["near"], s["best"]

        def merged(at: Column) -> Column:
            changed = lambda after: F.overlay(near, F.concat(made(t, after, at - 1), made(t, after, at)), at - 1, F.lit(3))
            after = F.array(F.overlay(letters, best, at, F.lit(2)))
            fresh = lambda _, x: F.struct(x.alias("letters"), changed(x).alias("near"), best.alias("best"))
            return F.aggregate(after, s, fresh, lambda x: state(x["letters"], x["near"]))

        return F.when(best == NONE, s).otherwise(then(F.instr(near, best), s, merged))

    padded = F.concat(F.lit(PAD), letters, F.lit(PAD))
    start = let(padded, lambda x: let(neighbours(t, x), lambda near: state(x, near)))
    # n tokens take n - 1 merges at most.
    return F.replace(F.aggregate(F.slice(steps, F.lit(2), F.lit(SHORT)), start, step, lambda s: s["letters"]), F.lit(PAD), F.lit(""))


def fold_long(t: Column, letters: Column, steps: Column) -> Column:
    """As `fold`, for long words: a step merges a pair at all its places.

    That equals merging it place by place from the left unless a pair that arises on the way ranks below it; then the
    step merges the leftmost place alone.
    """

    def state(letters: Column) -> Column:
        return let(neighbours(t, letters), lambda near: F.struct(letters.alias("letters"), near.alias("near"), least(near).alias("best")))

    def merged(s: Column, at: Column) -> Column:
        letters, best = s["letters"], s["best"]
        everywhere = state(F.replace(letters, F.substring(letters, at, F.lit(2)), best))
        once = state(F.concat(F.substring(letters, F.lit(1), at - 1), best, F.substring(letters, at + 2, F.lit(1 << 30))))
        between = F.coalesce(found(t["ranks"], F.concat(best, F.substring(letters, at, F.lit(1)))), F.lit(NONE))
        return let(everywhere, lambda x: F.when((x["best"] > best) & (~F.contains(x["letters"], F.concat(best, best)) | (between > best)), x).otherwise(once))

    def step(s: Column, _: Column) -> Column:
        return F.when(s["best"] == NONE, s).otherwise(let(F.instr(s["near"], s["best"]), lambda at: merged(s, at)))

    padded = F.concat(F.lit(PAD), letters, F.lit(PAD))
    return F.replace(let(padded, lambda x: F.aggregate(steps, state(x), step, lambda s: s["letters"])), F.lit(PAD), F.lit(""))


def encode_word(t: Column, word: Column) -> Column:
    """Letters of the tokens of one word that is no token itself."""

    def of(bytes_: Column) -> Column:
        letters = F.array_join(F.transform(bytes_, lambda c: F.get(t["vocabulary"]["byte"], F.ascii(c))), "")
        return F.when(F.size(bytes_) <= SHORT, fold(t, letters, bytes_)).otherwise(fold_long(t, letters, bytes_))

    def parts(bytes_: Column) -> Column:
        n = F.size(bytes_)
        joined = F.zip_with(F.slice(bytes_, F.lit(1), n - 1), F.slice(bytes_, F.lit(2), n - 1), lambda a, b: F.get(t["vocabulary"]["inside"], F.ascii(a) * 256 + F.ascii(b)))
        ends = F.concat(let(joined, lambda joined: F.filter(F.sequence(F.lit(1), n - 1), lambda i: ~F.get(joined, i - 1))), F.array(n))
        return let(ends, lambda ends: F.zip_with(F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1)), ends, lambda a, b: F.slice(bytes_, a + 1, b - a)))

    # Each byte is one letter of ISO 8859-1, whose code is the byte.
    bytes_ = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
    return let(bytes_, lambda x: F.when(F.size(x) <= SHORT, of(x)).otherwise(F.array_join(F.transform(parts(x), of), "")))


def known_words(df: DataFrame, column: str, path: str | None = None, words: int = WORDS, counted: int | None = COUNTED_ROWS) -> DataFrame:
    """(word, letters, n) of every token that is a text, and of the `words` most frequent other words of about `counted` rows (None: of all), each folded once.

    The number of partitions is given, since Spark would else fold all words in one task beside the tokens' greater join. n: how often those rows have the word; null if never.
    """
    spark = df.sparkSession
    texts = {}
    for token, rank in ranks_of(path).items():
        try:
            texts[token.decode()] = chr(rank)
        except UnicodeDecodeError:
            continue
    tokens = spark.createDataFrame(pa.table({"word": list(texts), "letters": list(texts.values())}))
    if counted is not None and (n := df.count()) > counted:
        df = df.sample(counted / n, 7)
    seen = df.select(F.explode(words_of(df[column], spark)).alias("word")).where(F.octet_length("word") <= WORD_BYTES)
    seen = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    others = seen.join(tokens, "word", "left_anti").orderBy(F.desc("n"), "word").limit(words)
    tables = {"vocabulary": vocabulary_table(spark, path), "ranks": rank_table(spark, path)}
    return tokens.join(seen, "word", "left").unionByName(with_scalar(others.repartition(max(1, words >> 14), "word"), tables, lambda t: encode_word(t, F.col("word")), "letters"))


def letters_of(df: DataFrame, column: str, name: str, path: str | None = None, words: int = WORDS, counted: int | None = COUNTED_ROWS) -> DataFrame:
    """`df` with `name`: a letter for each token of the whole text, whose code is the token's id."""
    spark = df.sparkSession
    known = cut(known_words(df, column, path, words, counted))
    hot = known.orderBy(F.desc_nulls_last("n"), "word").limit(HOT)
    tables = {"vocabulary": vocabulary_table(spark, path), "ranks": rank_table(spark, path), "known": word_table(known), "hot": word_table(hot, HOT_SLOTS)}

    def encoded(t: Column, word: Column) -> Column:
        return F.coalesce(found(t["hot"], word, HOT_SLOTS), found(t["known"], word), encode_word(t, word))

    return with_scalar(df, tables, lambda t: F.array_join(F.transform(words_of(F.col(f"`{column}`"), spark), lambda w: encoded(t, w)), ""), name)


def tokens_of(letters: Column) -> Column:
    return F.when(letters == "", F.array().cast("array<string>")).otherwise(F.split(letters, ""))


def encode(df: DataFrame, column: str = "text", path: str | None = None, words: int = WORDS, counted: int | None = COUNTED_ROWS) -> DataFrame:
    """`df` with token_ids array<int>: the ids of the whole text, as the vocabulary's own library gives them; no special tokens.

    Null and empty texts get an empty list. A column of `df` named token_ids is replaced; others stay, whatever their names.
    An empty table stays empty. Rows with equal texts are encoded one by one.
    """
    done = letters_of(df, column, "token_ids", path, words, counted)
    return done.withColumn("token_ids", F.transform(tokens_of(F.col("token_ids")), F.ascii))


def decode(df: DataFrame, column: str = "token_ids", path: str | None = None) -> DataFrame:
    """`df` with decoded binary: the bytes of the tokens of `column` (ids), one after another; a null list is empty."""
    ids = F.coalesce(F.col(f"`{column}`"), F.array().cast("array<int>"))
    return with_scalar(df, {"t": token_table(df.sparkSession, path)}, lambda x: pieces(x["t"], ids), "decoded")


def pieces(tokens: Column, of: Column, id_of: Callable[[Column], Column] = lambda i: i) -> Column:
    """The tokens' bytes in one binary, for ids or what `id_of` makes ids of. Strings are joined, since only they have a join in linear time."""
    return F.array_join(F.transform(of, lambda i: F.get(tokens, id_of(i))), "").cast("binary")


def little_endian(tokens: Column) -> Column:
    """The codes of letters as unsigned 32-bit integers, least byte first: in UTF-16 so ordered, with a zero letter behind each."""
    return F.when(F.size(tokens) == 0, F.lit(b"")).otherwise(F.encode(F.concat(F.array_join(tokens, "\0"), F.lit("\0")), "UTF-16LE"))


def with_scalar(df: DataFrame, tables: dict[str, DataFrame], body: Callable[[Column], Column], name: str) -> DataFrame:
    """`df` with `name`: `body` of a struct of the single values of `tables`. A column of that name is replaced.

    The analyser allows no subquery inside a higher-order function, so the scalars stand in a projection of their own; the
    optimiser puts them in the one place where they are used, and no row ever holds them.
    """
    kept = [c for c in df.columns if c != name]
    bound = df.select(*[df[c] for c in df.columns], F.struct(*[t.scalar().alias(k) for k, t in tables.items()]).alias("__scalars"))
    return bound.select(*[F.col(f"`{c}`") for c in kept], let(F.col("__scalars"), body).alias(name))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: what `encode` gives and `decode` makes of it."""
    # The letters are used twice here, so the optimiser leaves them a projection of their own; in one with the scalar, each row would hold a copy of that (1 MB).
    ids = letters_of(docs.select("doc_id", "text"), "text", "letters", path).select("doc_id", "letters", F.length("letters").cast("long").alias("n_tokens"))

    def both(x: Column) -> Column:
        sums = lambda tokens: F.struct(F.sha2(little_endian(tokens), 256).alias("ids"), F.sha2(pieces(x["t"], tokens, F.ascii), 256).alias("decoded"))
        return let(tokens_of(F.col("letters")), sums)

    done = with_scalar(ids, {"t": token_table(docs.sparkSession, path)}, both, "digests")
    return done.select("doc_id", "n_tokens", F.col("digests.ids").alias("ids_sha256"), F.col("digests.decoded").alias("decoded_sha256"))
