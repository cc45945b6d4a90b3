"""The prefix trie, byte-level BPE and lexical search against plain restatements."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skylattice.llm import bytebpe, lexical, prefixtrie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_trie(turns, base=None, head=None):
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    built = own if base is None else {c: own.get(base(c), [])[: head(c)] + v[head(c) :] for c, v in own.items()}
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []

    def below(p):
        leaves, saved = (0 if kids[p] else 1), (len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        for q in kids[p]:
            a, b = below(q)
            leaves, saved = leaves + a, saved + b
        ends = ",".join(str(c) for c in members[p] if len(built[c]) == len(p))
        out.append((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if built:
        below(())
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string"


def some_turns(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(-30, 90):
        text = rng.choice(["a b", "c", "", None, "hot turn", "hot turn", "hot turn"])
        for t in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "user", "user", None]), text if t < 3 else rng.choice(["x", "y z"])))
    rows += [(c, t, "user", "copy of many words") for c in range(100, 400) for t in range(4)]
    rows += [(None, 1, "user", "nobody's"), (5, 1, "user", "tie"), (5, 1, "user", "tie")]
    rows += [(500, t, "user", "long") for t in range(700)] + [(501, t, "user", "long") for t in range(650)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("rows", "parts"), [(7, 3), (1 << 16, 1), (1, 5)])
def test_trie_by_brute_force(spark, monkeypatch, rows, parts):
    monkeypatch.setattr(prefixtrie, "BLOCK_ROWS", rows)
    monkeypatch.setattr(prefixtrie, "CHUNK", 3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        turns = some_turns(rows)
        df = spark.createDataFrame(turns, TURNS).select("*", F.lit(1).alias("depth"), F.lit("x").alias("key"), F.lit(0).alias("block"), F.lit(0).alias("words"))
        conv = F.col("conv_id")
        got = prefixtrie.trie(df, conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4, 3)
        want = plain_trie(turns, lambda c: c - int(math.fmod(c, 20)), lambda c: zlib.crc32(str(c).encode()) % 4)
        assert sorted(map(tuple, got.collect()), key=str) == want
        assert sorted(map(tuple, prefixtrie.trie(df).collect()), key=str) == plain_trie(turns)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_of_nothing(spark):
    assert prefixtrie.trie(spark.createDataFrame([], TURNS)).collect() == []
    assert prefixtrie.trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).collect() == []
    alone = prefixtrie.trie(spark.createDataFrame([(3, None, None, None)], TURNS)).collect()
    assert sorted(map(tuple, alone), key=str) == plain_trie([(3, None, None, None)])


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(1)
    some = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["", None, "hello world it's we'll", "a" * 5000, " " * 3001 + "x", "=" * 777, "<|endoftext|>", some(3000, "abcdefghijklmnopqrstuvwxyz"), some(2000, "天地玄黃宇宙洪荒日月盈昃辰宿列張")]
    texts += [some(rng.randint(1, 60), "ab cde'stlmrv  \n\té中0 1!?\x00\x1c\x85　") for _ in range(500)]
    texts += ["".join(map(chr, rng.choices(points, k=20))) for _ in range(200)] + [some(rng.randint(65, 300), "ab") for _ in range(30)] + [some(rng.randint(65, 300), "aeinst") for _ in range(60)]
    texts += ["".join(map(chr, points[i : i + 4000])) for i in range(0, len(points), 4000)] + ["word " * 280_000]
    return texts + texts[2:5]


def test_bytes_as_the_library(spark, library):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("*", F.lit(1).alias("token_ids"), F.lit("x").alias("letters"), F.lit(2).alias("t"))
    got = {r.doc_id: r for r in bytebpe.decode(bytebpe.encode(df.repartition(8))).select("doc_id", "token_ids", "decoded").toLocalIterator()}
    digest = {r.doc_id: r for r in bytebpe.digests(df.withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))).collect()}
    for i, x in enumerate(texts):
        ids = library.encode_ordinary(x or "")
        assert got[i].token_ids == ids
        assert bytes(got[i].decoded) == (x or "").encode()
        d = digest[i or None]
        assert (d.n_tokens, d.ids_sha256, d.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest())


def test_bytes_without_known_words(spark, library):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["unforgettable lettering, antidisestablishmentarianism", "xyzzy plugh", None])], "doc_id long, text string")
    for r in bytebpe.encode(df, words=0).collect():
        assert r.token_ids == library.encode_ordinary(r.text or "")
    none = df.where("false")
    assert bytebpe.digests(none).collect() == []
    assert bytebpe.decode(spark.createDataFrame([(None,)], "token_ids array<int>")).first().decoded == b""


def test_bytes_rank_map_has_one_pair_a_token(spark):
    """Every pair that spells a token stood there once, and an empty map in each empty list."""
    sizes = bytebpe.rank_table(spark).select(F.explode("t").alias("m")).agg(F.sum(F.size("m")).alias("n"), F.count_if(F.size("m") == 0).alias("empty"), F.count_if(F.col("m").isNull()).alias("none")).first()
    assert sizes.n <= len(bytebpe.ranks_of()) - 256 and sizes.empty == 0 and sizes.none > 0


def test_bytes_frequent_words_are_counted(spark):
    """The tokens' counts choose what has a small table of its own."""
    df = spark.createDataFrame([(1, "the" + " the" * 9 + " xyzzyx" * 5), (2, None)], "doc_id long, text string")
    known = {r.word: r for r in bytebpe.known_words(df, "text").where("n > 0").collect()}
    assert {k: r.n for k, r in known.items()} == {" the": 9, " xyzzyx": 5, "the": 1}


@pytest.mark.parametrize("seed", range(3))
def test_bytes_of_untrained_ranks(spark, tmp_path, seed):
    """Ranks in any order, among them tokens that no merges make: pairs besides a token's last own one must not be missed."""
    import public_tokenizers as P
    import tiktoken

    rng = random.Random(seed)
    tokens = list({"".join(rng.choices("abc", k=rng.randint(2, 6))).encode() for _ in range(80)})
    rng.shuffle(tokens)
    ranks = {x: i for i, x in enumerate([bytes([i]) for i in range(256)] + tokens)}
    (tmp_path / "ranks").write_bytes(b"".join(base64.b64encode(k) + b" %d\n" % v for k, v in ranks.items()))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [" ".join("".join(rng.choices("abc", k=rng.randint(1, 40))) for _ in range(6)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for words in (0, 100):
        for r in bytebpe.encode(df, path=str(tmp_path / "ranks"), words=words).collect():
            assert r.token_ids == own.encode_ordinary(r.text)


def test_bytes_plan_has_no_copy_of_the_tables(spark):
    """The scalars are bound where they are used; a projection of their own would copy them into every row."""
    plan = bytebpe.encode(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "AS __scalars" not in plan


def test_bytes_digests_hold_no_copy_of_the_tokens(spark):
    """The letters are used twice, which once kept them and the scalar of the tokens in one projection."""
    plan = bytebpe.digests(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "AS __scalars" not in plan


def plain_search(docs, queries, k):
    terms = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    bags = [(d, Counter(terms(x))) for d, x in docs if terms(x)]
    total, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in queries:
        scored = []
        for d, b in bags:
            m = 100 - 50 + (50 * sum(b.values()) * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m)) for t in set(terms(text)) if b[t])
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(item, i, d, -s) for i, (s, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("docs", "window", "share"), [(16384, 4096, 0.25), (50, 7, 0.25), (400, 16, 0.0), (64, 8, 10.0)])
def test_search_by_brute_force(spark, monkeypatch, docs, window, share):
    for name, value in (("BLOCK_DOCS", docs), ("WINDOW", window), ("SHORT_SHARE", share), ("CHUNK_QUERIES", 4)):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(docs)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    texts = [" ".join(rng.choices(words, weights, k=rng.choice([0, 1, 5, 30, 90]))) for _ in range(700)]
    texts += ["W1 w2,w3"] * 80 + [None, "", "É é Ⅷ word_w1", "w5 " * 60_000, "-- !!"]
    rows = [(i if i != 3 else None, x) for i, x in enumerate(texts)] + [(7, texts[7])]
    queries = [(0, "w1 w2 w3 w40"), (1, "w59 w58"), (2, "É w1 W1 w1"), (3, None), (4, "nowhere"), (0, "w7"), (None, "w9 w55"), *[(i, " ".join(rng.choices(words, k=8))) for i in range(10, 20)]]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("n"), F.lit("x").alias("terms"), F.lit(1).alias("score"), F.lit(2).alias("query"))
    items = spark.createDataFrame(queries, "item_id long, text string").select("*", F.lit(1).alias("rank"))
    assert sorted(map(tuple, lexical.search(df.repartition(5), items, 9).collect()), key=str) == plain_search(rows, queries, 9)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.where("false"), items).collect() == []
    assert lexical.search(docs, items.where("false")).collect() == []
    assert lexical.search(docs.withColumn("text", F.lit(None).cast("string")), items).collect() == []


def test_composition_is_the_librarys():
    import unicodedata

    from tokenizers import normalizers

    from skylattice.llm import bpe

    nfc, rng = normalizers.NFC(), random.Random(2)
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c)) or any(a <= c <= b for a, b in bpe.APART)]
    letters = [*"aeoéü가각ㅏnｶ", *map(chr, (0x11935, 0x11930, 0x1100, 0x1161, 0x11A8))]
    texts = ["q" + o + m + o for m in marks for o in "\u0301\u0316\u05b0\u3099\u0334\u0345"]
    texts += ["".join(rng.choice(marks if rng.random() < 0.6 else letters) for _ in range(rng.randint(2, 7))) for _ in range(100_000)]
    assert [x for x in texts if bpe.composed(x) != nfc.normalize_str(x)] == []


def test_no_group_is_torn_for_nothing(spark):
    from skylattice.llm import sharding

    for sf in ("0.001", "0.01"):
        placed = sharding.shard(spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet"))
        rows = placed.groupBy("text_crc32", "size").agg(F.count_distinct("shard").alias("shards")).where("shards > 1").count()
        assert rows == 0, sf


def test_heavy_groups_are_cut_where_that_evens_shards():
    import numpy as np

    from skylattice.llm import sharding

    need, fair = np.array([10.0, 2.0, 1.0]), np.array([1000.0, 200.0, 100.0])
    whole = [(i, i, 10, need) for i in range(24 * 10)]
    placed, _ = sharding.split_heavy(whole, fair, 24)
    assert len(placed) == 240
    uneven = [(i, i, 60, need) for i in range(40)]  # 0.6 of a shard each: whole, some shards would get two and some one
    placed, room = sharding.split_heavy(uneven, fair, 24)
    assert len(placed) > 40 and room.min() > -0.1
    assert sorted((a, b) for h, _, a, b, _ in placed if h == 0)[0][0] == 0 and sum(b - a for h, _, a, b, _ in placed if h == 0) == 60
