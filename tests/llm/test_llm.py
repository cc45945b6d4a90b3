"""The llm operators against brute force, exact round trips and held-out labels, with hard rows in every table."""

from __future__ import annotations

import hashlib
import math
import os
import random
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.llm import bagminhash as bmh
from skylattice.llm import bpe, chat, common, fingerprint, gif, linededup, links, lm, mixing, neardup, quality, queries, sharding

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string"
WORDS = [w + x for w in ("ba", "de", "ki", "lo", "mu", "na") for x in ("r", "st", "n", "l", "ra", "to", "ve")]


def text(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ",", "."]) for _ in range(n))


HARD = [
    (1, None, None, None, None, "x", "y"),
    (2, "", "en", "a", 0, None, None),
    (3, " \n\t\n ", "en", "a", 5, None, None),
    (4, "one", "en", None, 3, None, None),
    (4, "one", "en", None, 3, None, None),
    (5, text(1, 90), "en", "b", 1, None, None),
    (6, text(1, 90), "en", "b", 1, None, None),
    (7, text(1, 89) + " changed", "en", "a", 1, None, None),
    (8, "A" * 5000 + " " + text(2, 4000), "en", "c", 1, None, None),
    (9, "ÀÉÎ 中文 😀 Σ\x1c\x00 <|endoftext|>'ll", "xx", "c", 1, None, None),
    (-(2**60), "far id " + text(3, 30), "en", "c", 1, None, None),
    (10, "\n".join([text(20, 30), text(21, 30), "Short."]), "en", "c", 1, None, None),
    (11, "\n".join(["Other.", text(20, 30), text(21, 30), "Short."]), "en", "c", 1, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(HARD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    return t


def test_bpe_is_the_library(docs, none, tokenizer):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs).collect()}
    want = set()
    for i, t, *_ in HARD:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
    assert bpe.digests(none).count() == 0


def test_bpe_on_odd_strings(tokenizer):
    import public_tokenizers

    r = random.Random(5)
    parts = ["a", "B", "é", "é", "Σ", " ", "\n", "1", "中", "😀", "'s", "'ll", "<|endoftext|>", "ß", "\x1c", "$$", "the", "ing", "ß", "İ", "\x85"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(1500)] + ["ab" * 3000, "a" * 9000]
    path = public_tokenizers.path("word_bpe_49k.json")
    assert list(bpe.tokens(texts, path)) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_bpe_splits_every_code_point_as_the_library(tokenizer):
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        v = bpe.Vocabulary(f.read())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 4000):
        shown = tokenizer.normalizer.normalize_str(" ".join(f"a{chr(c)}b {chr(c)}. x{chr(c)}" for c in points[i : i + 4000]))
        want = [shown[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(shown)]
        assert v.pieces.findall(shown) == want
    texts = [f"a{chr(c)}b {chr(c)}. x{chr(c)}" for c in points if c < 0x3400 or 0xA000 <= c < 0xAC00 or 0xF900 <= c < 0x11000 or c % 37 == 0]
    assert [v.encode(x).tolist() for x in texts] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_automaton_finds_the_longest_word_at_each_end():
    r = random.Random(3)
    words = {"".join(r.choice("ab") for _ in range(r.randint(1, 6))): i for i in range(30)}
    goto, fail, best = bpe.automaton(words.items())
    for _ in range(200):
        s, state = "".join(r.choice("abc") for _ in range(40)), 0
        for k, c in enumerate(s):
            while (to := goto.get(state << 9 | ord(c))) is None and state:
                state = fail[state]
            state = to or 0
            ends = [w for w in words if s[: k + 1].endswith(w)]
            assert best[state] == (words[max(ends, key=len)] if ends else None)


def test_extra_columns_stay_and_results_replace_their_namesakes(docs):
    out = bpe.encode(docs.withColumn("token_ids", F.lit("old")))
    assert out.columns == [*docs.columns, "token_ids"] and dict(out.dtypes)["token_ids"] == "array<int>"
    assert out.count() == len(HARD)


def test_quality_learns_without_the_held_out(spark, docs, none):
    rows = [(i, text(i, 60) if i % 3 else " ".join(f"{w.upper()}!!" for w in text(i, 40).split())) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(7, None), (7, 1)], "doc_id long, quality int")
    got = quality.classify(d, labels).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 400 and {r.held_out for r in got} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    turned = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {(r.doc_id, r.score) for r in quality.classify(d, turned).collect()} == {(r.doc_id, r.score) for r in got}
    assert quality.classify(docs, labels).count() == len(HARD)
    assert quality.classify(none, labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(d, labels)
    assert kept.columns == d.columns and 0 < kept.count() < 400


def test_isotonic_pools_violators():
    at, value = quality.isotonic(np.array([0.0, 1.0, 2.0, 3.0]), np.array([1, 1, 1, 1]), np.array([0, 1, 0, 1]))
    assert value.tolist() == [0, 0.5, 1] and at.tolist() == [0, 1.5, 3]


def test_shards_are_even_and_gapless(spark, docs, none):
    r = random.Random(2)
    rows = [(i, text(i % 300 if i % 2 else -1, 5 + i % 40)) for i in range(3000)]
    rows = [(i, t if i % 2 else "a third of all rows") for i, t in rows]
    r.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(d, 6).collect()
    size, count = Counter(), Counter()
    slots, homes = defaultdict(list), defaultdict(set)
    texts = dict(rows)
    for x in got:
        assert (x.size, x.text_crc32) == (len(texts[x.doc_id].encode()) + 8, zlib.crc32(texts[x.doc_id].encode()))
        size[x.shard] += x.size
        count[x.shard] += 1
        slots[x.shard].append(x.slot)
        homes[texts[x.doc_id]].add(x.shard)
    assert len(got) == 3000 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(size.values()) < 1.03 * min(size.values()) and max(count.values()) < 1.05 * min(count.values())
    assert all(len(v) == 1 for t, v in homes.items() if t != "a third of all rows")
    assert sorted((x.doc_id, x.shard, x.slot) for x in sharding.shard(d.repartition(7), 6).collect()) == sorted((x.doc_id, x.shard, x.slot) for x in got)
    assert sharding.shard(docs).count() == len(HARD)
    assert sharding.shard(none).count() == 0


def test_gif_codes_round_trip():
    for n in (0, 1, 63, 64, 257, 5000, 70_000):
        for data in (os.urandom(n), bytes(n), bytes(random.Random(n).choices(b"abc", k=n))):
            assert gif.lzw_decode(gif.lzw_encode(data), 8, n) == data


def codes(values: list[int], widths: list[int]) -> bytes:
    n = shift = 0
    for v, w in zip(values, widths, strict=True):
        n |= v << shift
        shift += w
    return n.to_bytes(-(-shift // 8), "little")


def animation() -> bytes:
    """Three 2 x 2 frames with min code size 2: a full one kept, a one-pixel one restored, a transparent one."""

    def frame(box, disposal, clear, pixels, delay):
        values, widths, seen = [4], [3], 0
        for p in pixels:  # a clear code before each sample keeps the width at 3
            values += [p, 4]
            widths += [3, 3]
            seen += 1
        body = codes([*values[:-1], 5], [*widths[:-1], 3])
        head = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, clear or 0, 0)
        return head + struct.pack("<BHHHHB", 0x2C, *box, 0) + bytes([2, len(body)]) + body + b"\0"

    palette = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
    head = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x80 | 1, 0, 0) + palette
    return head + frame((0, 0, 2, 2), 1, None, [0, 1, 2, 3], 5) + frame((1, 1, 1, 1), 3, None, [0], 7) + frame((0, 0, 2, 2), 2, 1, [1, 1, 2, 1], 9) + frame((0, 0, 1, 1), 0, None, [3], 1) + b"\x3b"


def test_gif_palette_disposal_and_transparency(spark):
    red, green, blue, grey = (255, 0, 0), (0, 255, 0), (0, 0, 255), (9, 9, 9)
    frames = list(gif.gif_frames(animation()))
    shown = [[tuple(f.canvas[y, x, :3].tolist()) for y in (0, 1) for x in (0, 1)] for f in frames]
    assert shown[0] == [red, green, blue, grey]
    assert shown[1] == [red, green, blue, red]
    assert shown[2] == [red, green, blue, grey]  # the second was undone, the third shows through
    assert [f.delay_ms for f in frames] == [50, 70, 90, 10]
    assert frames[3].canvas[0, 0].tolist() == [9, 9, 9, 255] and frames[3].canvas[1, 1, 3] == 0  # cleared to background
    assert frames[0].histogram().sum() == 12
    df = spark.createDataFrame([(bytearray(animation()),), (None,), (bytearray(b"no"),)], "gif binary")
    got = [r.frames for r in gif.read_frames(df).collect()]
    assert len(got[0]) == 4 and got[1] is None and got[2] is None


def test_media_reads_back(spark, docs, tmp_path):
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op4_gif_media(spark, str(tmp_path)).collect()}
    for i, t, *_ in HARD:
        data = (t or "").encode()
        data += bytes(-len(data) % 64 or (0 if data else 64))
        assert (got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32, got[i].n_bytes) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len((t or "").encode()))


def brute_lines(rows: list[tuple], least: int) -> dict:
    """Every stretch of lines that starts earlier in the corpus too, by trying all pairs of starts."""
    lines = {i: [(j, x, len(x.encode().split())) for j, x in enumerate((t or "").split("\n")) if x.encode().split()] for i, t in rows}
    starts = [(i, k) for i in sorted(lines) for k in range(len(lines[i]))]
    gone = defaultdict(set)
    for n, (i, k) in enumerate(starts):
        for j, m in starts[:n]:
            run = words = 0
            while k + run < len(lines[i]) and m + run < len(lines[j]) and lines[i][k + run][1] == lines[j][m + run][1]:
                words += lines[i][k + run][2]
                run += 1
            if words >= least:
                gone[i] |= {lines[i][k + x][0] for x in range(run)}
    return {i: "\n".join(x for j, x in enumerate((t or "").split("\n")) if j not in gone[i]) for i, t in rows}


@pytest.mark.parametrize("least", [3, 6])
def test_line_dedup_is_brute_force(spark, least):
    r = random.Random(least)
    pool = ["a b", "c", "d e f", "g", "h i", "", " "]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 9)))) for i in range(60)]
    got = {x.doc_id: x.text for x in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), least).collect()}
    assert got == brute_lines(rows, least)


def test_line_dedup_hard_rows(docs, none):
    got = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    assert got[1].text is None and got[2].text == "" and got[6].text == "" and got[5].text == text(1, 90)
    assert got[11].text == "Other." and got[10].n_removed == 0 and got[7].n_removed == 0
    assert linededup.dedup_lines(docs).count() == len(HARD) and linededup.dedup_lines(none).count() == 0


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(1)
    a, b, true = [], [], []
    for _ in range(150):
        p = np.sort(r.integers(0, 2**63, 50).astype(np.uint64))
        x = r.integers(0, 9, 50)
        y = np.maximum(x + r.integers(-3, 4, 50) * (r.random(50) < 0.5), 0)
        a.append((p[x > 0], x[x > 0]))
        b.append((p[y > 0], y[y > 0]))
        true.append(np.minimum(x, y).sum() / np.maximum(x, y).sum())
        assert bmh.likeness(a[-1], b[-1]) == pytest.approx(true[-1])
    s, t = bmh.signatures(a), bmh.signatures(b)
    assert abs((s == t).mean() - np.mean(true)) < 0.015
    assert (bmh.signatures(a[:5]) == s[:5]).all()


def test_near_dedup_is_brute_force(spark, docs, none):
    r = random.Random(4)
    rows = []
    for g in range(12):
        base = text(100 + g, 80).split()
        for k in range(8):
            t = list(base)
            for _ in range(k % 4):
                t[r.randrange(len(t))] = f"new{r.random()}"
            rows.append((len(rows), " ".join(t)))
    rows += [(len(rows), "x y"), (len(rows) + 1, "x y"), (len(rows) + 2, ""), (len(rows) + 3, None)]
    bags = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").split()) else Counter() for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            low, high = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if (rows[i][1] or "") == (rows[j][1] or "") or high and low / high >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    got = {x.doc_id: x.class_id for x in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(rows))}
    hard = {(x.doc_id, x.class_id) for x in neardup.classes(docs).collect()}
    assert {(5, 5), (6, 5), (7, 5), (4, 4), (1, 1), (2, 1)} <= hard
    assert neardup.classes(none).count() == 0
    one = neardup.one_each(docs)
    assert one.columns == docs.columns and sorted(x.doc_id for x in one.collect()) == [-(2**60), 1, 3, 4, 5, 8, 9, 10]


def test_pairs_of_a_bucket_are_all_decided(spark, monkeypatch):
    """Classes of one bucket, in one block or in tiles of a few members each, are those of its true links."""
    r = random.Random(8)
    for true in ({(1, 60), (2, 59), (1, 2)}, {(i, j) for j in range(1, 61) for i in range(1, j) if r.random() < 0.02}):
        nodes = spark.createDataFrame([(i, [1, 2], 1) for i in range(1, 61)], "node long, keys array<long>, size long")
        want = {x.node: x.label for x in links.components(spark.createDataFrame(sorted(true), "a long, b long")).collect()}

        def decide(bags, side, label, true=true):
            pairs = ((i, j) for j in range(len(bags)) for i in range(j) if side is None or side[i] != side[j])
            return [(i, j) for i, j in pairs if (int(bags[i]), int(bags[j])) in true]

        for block in (1024, 7):
            monkeypatch.setattr(links, "BLOCK", block)
            texts = lambda places: places.withColumn("text", F.col("node").cast("string"))
            assert {x.node: x.label for x in links.linked(nodes, texts, str, decide).collect()} == want


def test_links_of_a_block_are_brute_force():
    r = random.Random(6)
    texts = [text(1, 300), "a " * 900, "a " * 880 + text(3, 20), "x y", text(2, 3), ""]
    for _ in range(90):
        t = r.choice(texts[:3]).split()
        for _ in range(r.randint(0, 9)):
            t[r.randrange(len(t))] = r.choice(["new", f"n{r.random()}"])
        texts.append(" ".join(t))
    bags = [bmh.bag(t) for t in texts]
    n = len(bags)
    true = np.array([[len(a[0]) and len(b[0]) and bmh.likeness(a, b) >= 0.8 for b in bags] for a in bags], bool)

    def classes(pairs, klass):
        klass = np.array(klass)
        for i, j in pairs:
            klass[klass == klass[j]] = klass[i]
        return {tuple(np.flatnonzero(klass == k)) for k in klass}

    side, label = np.arange(n) % 2, np.arange(n) // 3
    for s, lab in ((None, None), (side, None), (side, label), (None, label)):
        across = true if s is None else true & (s[:, None] != s)
        start = np.arange(n) if lab is None else lab
        got = bmh.links(bags, 0.8, s, lab)
        assert all(across[i, j] for i, j in got) and len(got) < n
        assert classes(got, start) == classes(zip(*np.nonzero(across)), start)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {x.node: x.label for x in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_mix_meets_targets(spark, docs, none):
    r = random.Random(9)
    rows = [(i, "s0" if i % 3 else f"s{i % 5}", text(i, r.randint(1, 30))) for i in range(900)] + [(900, None, "a b c"), (901, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(d).collect()
    size = Counter()
    for _, s, t in rows:
        size[s] += len((t or "").split())
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate([*sorted(x for x in size if x), None])}
    budget, capped = 1.5 * sum(size.values()), set()
    while True:  # share by weight, cap, share again
        rest = budget - sum(2 * size[s] for s in capped)
        total = sum(w for s, w in weight.items() if s not in capped)
        new = {s for s in weight if s not in capped and rest * weight[s] / total > 2 * size[s]}
        if not new:
            break
        capped |= new
    target = {s: 2 * size[s] if s in capped else rest * weight[s] / total for s in weight}
    taken = Counter()
    for x in got:
        assert x.target == pytest.approx(target[x.source]) and x.taken in (0, x.size, 2 * x.size) and x.source_size == size[x.source]
        taken[x.source] += x.taken
    assert all(abs(taken[s] - target[s]) <= 16 for s in target)
    assert sorted((x.doc_id, x.taken) for x in mixing.mix(d.repartition(5)).collect()) == sorted((x.doc_id, x.taken) for x in got)
    again = mixing.mixed(d)
    assert again.columns == d.columns and Counter(x.doc_id for x in again.collect()) == Counter({x.doc_id: x.copies for x in got if x.copies})
    assert mixing.mix(docs).count() == len(HARD) and mixing.mix(none).count() == 0


def slow_print(t: str) -> list[int]:
    cl = [int((np.uint32(ord(c)) * np.uint32(0x9E3779B1) >> np.uint32(8)) % np.uint32(fingerprint.END)) for c in t] + [fingerprint.END]
    shown, at = [], 0
    for j in range(2 * max(len(t), 1) + fingerprint.SPAN):
        shown.append(cl[at])
        at += int(fingerprint.moves(j // fingerprint.STEPS)[j % fingerprint.STEPS][cl[at]])
    steps = fingerprint.Samples().steps(np.array([len(t)]))[0]
    value = fingerprint.mixed(steps.astype(np.uint64) + np.uint64(fingerprint.SEED << 48))
    with np.errstate(over="ignore"):
        for k in range(fingerprint.SPAN):
            value = fingerprint.mixed(value * np.uint64(31) + np.array([shown[s + k] for s in steps], np.uint64))
    return (value >> np.uint64(48)).tolist()


def test_fingerprints_are_the_walk(spark, docs, none):
    texts = ["", "a", "ab", text(1, 50), text(2, 900), "é中😀" * 20]
    with np.errstate(over="ignore"):
        assert fingerprint.fingerprints(texts).tolist() == [slow_print(t) for t in texts]
    near = fingerprint.fingerprints([text(5, 300), text(5, 300).replace("bar", "baar", 2), text(6, 300)])
    assert fingerprint.likeness(near[0], near[1]) > 0.6 > 0.1 > fingerprint.likeness(near[0], near[2])
    got = {r.doc_id: r for r in fingerprint.with_next(docs.dropDuplicates(["doc_id"])).collect()}
    order = sorted({r[0]: r[1] or "" for r in HARD}.items(), reverse=True)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        edited = fingerprint.spliced(t, n)
        a, b, c = fingerprint.fingerprints([t, edited, n])
        x = got[i]
        assert (x.n_chars, x.fingerprint, x.edited_fingerprint) == (len(t), *fingerprint.hexed(np.stack([a, b])))
        assert x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (x.near_edited, x.near_next) == (fingerprint.likeness(a, b), fingerprint.likeness(a, c))
    assert fingerprint.with_next(docs).count() == len(HARD) and fingerprint.with_next(none).count() == 0
    assert fingerprint.with_next(docs.limit(1)).count() == 1
    assert fingerprint.fingerprint(docs, keep=["doc_id"]).count() == len(HARD)


def test_near_by_edits(spark):
    rows = [(1, text(1, 200)), (2, text(1, 200).replace("bar", "baar", 1)), (3, text(9, 200)), (4, ""), (5, None)]
    got = {r.doc_id: r.class_id for r in fingerprint.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_print_classes_by_brute_force(spark, tmp_path):
    """Classes of the op9 query's rows are the components of all pairs of fingerprints at NEAR or above."""
    r = random.Random(9)
    rows = []
    for k in range(60):
        base = text(1000 + k, r.randrange(5, 400))
        for c in range(r.randrange(1, 8)):
            words = base.split(" ")
            for _ in range(c * max(1, len(words) // 50)):
                words[r.randrange(len(words))] = r.choice(["bar", "zz", "qu"])
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, rows[0][1]), (None, rows[0][1]), (None, "of no id"), (len(rows) + 3, "a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op9_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    prints = np.array([np.frombuffer(bytes.fromhex(x.fingerprint), np.uint16) for x in got])
    klass = list(range(len(got)))
    for i, x in enumerate(got):
        for j in range(i):
            empty = (x.n_chars == 0) + (got[j].n_chars == 0)
            if klass[i] != klass[j] and (empty == 2 or empty == 0 and fingerprint.likeness(prints[i], prints[j]) >= fingerprint.NEAR):
                klass = [klass[j] if c == klass[i] else c for c in klass]
    least = {c: min((x.doc_id for x, d in zip(got, klass) if d == c and x.doc_id is not None), default=None) for c in klass}
    assert [x.class_id for x in got] == [least[c] for c in klass]
    assert 60 <= len(set(klass)) < len(rows) - 60


def test_lm_counts_exactly_and_predicts(spark, docs, none):
    r = random.Random(3)
    lines = [text(k, 12) for k in range(20)]
    rows = [(i, " ".join(r.choice(lines) for _ in range(6))) for i in range(150)] + [(150, None), (151, ""), (152, "Never seen words"), (153, "bar bar bar")]
    got = {x.doc_id: x for x in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    tokens = {i: [w.lower() for w in (t or "").encode().split()] + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert x.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert x.score < 0
    out = [x for x in got.values() if x.held_out and x.n_tokens > 20]
    assert out and sum(x.score for x in out) > 0.5 * sum(x.base_score for x in out)
    assert lm.score_texts(docs).count() == len(HARD) and lm.score_texts(none).count() == 0


def test_lm_scores_equal_texts_alike_in_any_chunk(spark):
    r = random.Random(12)
    rows = [(i, " ".join(x for _ in range(30) for x in ("hot", r.choice(WORDS)))) for i in range(60)] + [(200, "hot kin")]
    parts = [rows, [(201, "hot kin")], [(202, "hot kin"), (203, "hot bar hot lon hot de")]]
    dealt = spark.sparkContext.parallelize(range(3), 3).flatMap(lambda k: parts[k])
    got = {x.doc_id: x.score for x in lm.score_texts(spark.createDataFrame(dealt, "doc_id long, text string")).collect()}
    assert got[201] == pytest.approx(got[200], abs=1e-9) and got[202] == pytest.approx(got[200], abs=1e-9)


def one_by_one(c: int, rest: int, share: float, sweeps: int) -> float:
    """Mean tables of a dish by Gibbs sweeps in which each customer leaves and is seated again."""
    r, d, at = random.Random(c), lm.DISCOUNT, [c]
    seat, total = [0] * c, 0
    for k in range(sweeps):
        for j in range(c):
            at[seat[j]] -= 1
            t = sum(x > 0 for x in at)
            new = (lm.STRENGTH + d * (rest + t)) * share
            seat[j] = r.choices(range(len(at) + 1), [*(max(x - d, 0) for x in at), new])[0]
            if seat[j] == len(at):
                free = at.index(0) if 0 in at else len(at)
                at[free:free] = [0] * (free == len(at))
                seat[j] = free
            at[seat[j]] += 1
        total += sum(x > 0 for x in at) * (k >= sweeps // 5)
    return total / (sweeps - sweeps // 5)


def test_seating_has_the_exact_law(monkeypatch):
    """Mean tables of a dish against the law over table counts, by generalised Stirling numbers, and against seating one by one."""
    d = lm.DISCOUNT
    for exact, c, rest, share in ((1024, 2, 3, 0.1), (1024, 7, 0, 0.9), (1024, 30, 50, 0.05), (1024, 90, 400, 0.02), (64, 90, 400, 0.02), (64, 400, 2000, 0.05), (64, 200, 20, 0.001)):
        monkeypatch.setattr(lm, "EXACT", exact)
        lm.ways.cache_clear()
        ways = [0.0, 1.0]  # of n customers at t tables
        for n in range(1, c):
            ways = [0.0, *((n - d * t) * (ways[t] if t < len(ways) else 0) + ways[t - 1] for t in range(1, n + 2))]
            most = max(ways)
            ways = [x / most for x in ways]
        with np.errstate(divide="ignore"):
            law = np.log(ways) + np.array([sum(math.log((lm.STRENGTH + d * (rest + i)) * share) for i in range(1, t)) for t in range(len(ways))])
        law = np.exp(law - law.max())
        true = (law * np.arange(len(law))).sum() / law.sum()
        runs = 3000 if c <= exact else 900
        many = lambda x, runs=runs: np.full(runs, x)
        got = lm.seated(many(c), many(rest), many(share), np.arange(runs, dtype=np.uint64) * np.uint64(977)) / lm.SWEEPS
        assert got.min() >= 1 and got.max() <= c
        assert got.mean() == pytest.approx(true, rel=0.02)
        if c <= 30:
            assert one_by_one(c, rest, share, 2000) == pytest.approx(true, rel=0.05)
    lm.ways.cache_clear()
    assert lm.seated(np.array([0, 1]), many(0)[:2], many(0.5)[:2], np.arange(2, dtype=np.uint64)).tolist() == [0, lm.SWEEPS]


def test_lm_scores_do_not_depend_on_partitions(spark, monkeypatch):
    r = random.Random(13)
    rows = [(i, " ".join(x for _ in range(r.randint(1, 40)) for x in ("hot", r.choice(WORDS)))) for i in range(200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for shuffles, parts, chars in (("4", 1, 8 << 20), ("17", 3, 8 << 20), ("4", 16, 8 << 20), ("1", 2, 500)):
            spark.conf.set("spark.sql.shuffle.partitions", shuffles)
            monkeypatch.setattr(lm, "CHUNK_CHARS", chars)
            found.append({x.doc_id: x.score for x in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(x == pytest.approx(found[0], abs=1e-9) for x in found[1:])


def test_lm_probabilities_sum_to_one_and_follow_the_formula(spark):
    """Every known word and an unknown one after one context, against a plain model of the same tables."""
    r = random.Random(14)
    vocabulary = WORDS[:12]
    train = [(i, " ".join(["go", r.choice(vocabulary[:9]), r.choice(vocabulary)])) for i in range(400) if zlib.crc32(str(i).encode()) % 10]
    held = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 0]
    asked = [*vocabulary, "go", "unseen"]
    rows = train + [(held[k], f"go {w}") for k, w in enumerate(asked)] + [(held[-1], "go"), (held[-2], "")]
    got = {x.doc_id: x.score for x in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    c = Counter(w for _, t in train for w in [*t.split(), None])
    after = defaultdict(Counter)
    for _, t in train:
        words = [None, *t.split(), None]
        for u, w in zip(words, words[1:]):
            after[u][w] += 1
    n, v, d, s = sum(c.values()), len(c), lm.DISCOUNT, lm.SWEEPS

    def name(w):
        return lm.END_HASH if w is None else lm.xxhash.xxh64_intdigest(w.encode())

    place = {w: k for k, w in enumerate(sorted({w for _, t in rows for w in [*t.split(), None]}, key=name))}
    tables, spread, most = {}, Counter(), Counter()
    with np.errstate(over="ignore"):
        for u, ws in after.items():
            for w, k in ws.items():
                share = 2.0 ** (-round(-2048 * math.log2((c[w] + 0.1) / (n + 0.1 * (v + 1)))) / 2048)
                key = lm.mixed(lm.mixed(np.array([place[u] + 1], np.uint64)) * lm.GOLD + np.uint64(place[w]))
                t = int(lm.seated(np.array([k]), np.array([len(ws) - 1]), np.array([share]), key)[0])
                tables[u, w] = t
                spread[u] += t
                most[w] += t
        customers = {w: max(1, round(most[w] / s)) for w in c}
        own = {w: int(lm.seated(np.array([k]), np.array([v - 1]), np.array([1 / (v + 1)]), lm.mixed(np.array([name(w)], np.uint64) + np.uint64(77)))[0]) / s for w, k in customers.items()}
    rest = (lm.STRENGTH + d * sum(own.values())) / (v + 1)
    parent = lambda w: ((customers[w] - d * own[w] if w in c else 0) + rest) / (lm.STRENGTH + sum(customers.values()))
    p = lambda u, w: (after[u][w] - d * tables.get((u, w), 0) / s + (lm.STRENGTH + d * spread[u] / s) * parent(w)) / (lm.STRENGTH + c[u])
    for k, w in enumerate(asked):
        assert got[held[k]] == pytest.approx(sum(math.log10(p(a, b)) for a, b in ((None, "go"), ("go", w), (w, None))), abs=1e-5)
    assert got[held[-2]] == pytest.approx(math.log10(p(None, None)), abs=1e-5)
    assert sum(p("go", w) for w in [*c, "unseen"]) == pytest.approx(1)


def franchise(counts: dict, n_words: int, sweeps: int) -> np.ndarray:
    """Mean tables of each dish, then of the parent's words, by sweeps in which each customer leaves the franchise and comes back."""
    r, d, s = random.Random(5), lm.DISCOUNT, lm.STRENGTH
    rooms, parent = {k: [] for k in counts}, {w: [] for _, w in counts}

    def out(at):
        k = r.choices(range(len(at)), at)[0]
        at[k] -= 1
        if at[k]:
            return False
        del at[k]
        return True

    def back(at, new):
        k = r.choices(range(len(at) + 1), [*(x - d for x in at), new])[0]
        at[k : k + 1] = [at[k] + 1] if k < len(at) else [1]
        return k + 1 == len(at) and at[k] == 1

    total = np.zeros(len(counts) + len(parent))
    for sweep in range(sweeps):
        for (u, w), c in counts.items():
            for _ in range(c):
                if sweep and out(rooms[u, w]):
                    out(parent[w])
                base = (s + d * sum(map(len, parent.values()))) / (n_words + 1)
                p = (sum(parent[w]) - d * len(parent[w]) + base) / (s + sum(map(sum, parent.values())))
                if back(rooms[u, w], (s + d * sum(len(x) for (v, _), x in rooms.items() if v == u)) * p):
                    back(parent[w], base)
        if sweep >= sweeps // 10:
            total += [len(x) for x in (*rooms.values(), *parent.values())]
    return total / (sweeps - sweeps // 10)


def test_lm_chain_has_the_law_of_seating_one_by_one():
    """The chain over both levels, from sweep to sweep, against customers of a franchise seated one by one."""
    counts = {(0, 0): 9, (0, 1): 2, (0, 2): 1, (1, 0): 4, (1, 1): 14, (2, 2): 3, (2, 3): 1, (3, 0): 8}
    many, one, starts = [k for k in counts if counts[k] > 1], [k for k in counts if counts[k] == 1], np.array([0, 2])
    words = np.array(sorted({w for _, w in many}))
    state = lm.packed(
        np.arange(4), np.zeros(4, bool), np.bincount([u for u, _ in one], minlength=4), np.array([u for u, _ in many], np.int32),
        np.searchsorted(words, [w for _, w in many]).astype(np.int32), np.array([counts[k] for k in many]), words,
    )
    w, n = np.unique([w for _, w in one], return_counts=True)
    singles = {b: [(w[i:j] - starts[b]).astype(np.int32), n[i:j].astype(np.int32)] for b, i, j in lm.by_bucket(w, starts)}
    tables, log_p, parent, before = np.array([3, 2, 2, 1]), np.log(np.full(len(words), 0.2)), lm.Parent(4), {}
    total, sweeps = np.zeros(len(counts) + 4), 2500
    for sweep in range(sweeps):
        t, tables = lm.chained(state, tables, log_p, sweep)
        ups = list(lm.sent_up(0, state, t, tables, starts, None if sweep else singles))
        rate, n_tables, customers = parent.rate(next(x[4] for x in ups if x[0] == "sums"), sweep), 0, []
        for b in (0, 1):
            rows = [(kind, k, p) for kind, at, k, p, _ in ups if kind == "up" and at == b] + ([("parent", -1, before[b])] if b in before else [])
            before[b], x = lm.parent_of(rows, 2, 2 * b, sweep, rate, False)
            n_tables += x
            customers += lm.unpacked(before[b])[5].tolist()
        parent.seat(n_tables, sweep)
        sent = [lm.weights_of(before[b], 2 * b, sweep, parent.mass) for b in (0, 1)]
        every = parent.weigh(sum(x for _, x in sent), sweep)
        log_p = np.log(np.concatenate([np.frombuffer(p, np.float32) for x, _ in sent for _, p in x]) / every)
        if sweep >= 100:
            of = dict(zip(many, t.tolist()))
            total += [of.get(k, 1) for k in counts] + customers
    got, want = total / (sweeps - 100), franchise(counts, 4, 8000)
    assert got == pytest.approx(want, rel=0.05)
    assert want[0] > 1.3 and want[len(counts)] > 1.2  # not one table each


def test_lm_chain_carries_tables_and_does_not_depend_on_partitions(spark, monkeypatch):
    r = random.Random(15)
    rows = [(i, " ".join(x for _ in range(r.randint(1, 40)) for x in ("hot", r.choice(WORDS)))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0]
    asked = spark.createDataFrame([*[(i, t) for i, t in rows if i not in held], *((i, f"hot {w}") for i, w in zip(held, [*sorted(set(WORDS)), "unseen"]))], "doc_id long, text string")
    assert {x.doc_id for x in lm.score_texts(asked, burn=0).collect()} == {x.doc_id for x in asked.collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for shuffles, parts, chars in (("4", 1, 8 << 20), ("17", 3, 500)):
            spark.conf.set("spark.sql.shuffle.partitions", shuffles)
            monkeypatch.setattr(lm, "CHUNK_CHARS", chars)
            found.append({x.doc_id: x.score for x in lm.score_texts(df.repartition(parts), burn=2).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[1] == pytest.approx(found[0], abs=1e-6)
    first = {x.doc_id: x.score for x in lm.score_texts(df).collect()}
    assert found[0] != first and sum(found[0].values()) == pytest.approx(sum(first.values()), rel=0.02)
    none = lm.score_texts(spark.createDataFrame([(held[0], "only held out")], "doc_id long, text string"), burn=1).collect()
    assert [x.score for x in none] == [0.0] and lm.score_texts(df.limit(0), burn=1).count() == 0


def test_lm_draws_dishes_of_many_customers_together_as_one_by_one():
    r = np.random.default_rng(3)
    c = np.concatenate([r.integers(lm.EXACT + 1, 4000, 100), [20_000, 300_000]])
    for rate in (-5.0, 0.0, 4.0, 12.0):
        u = r.random(len(c))
        one_by_one = [lm._drawn_of_many(int(n), lambda t: t * rate, np.array([x]))[0] for n, x in zip(c, u)]
        assert lm._drawn_of_each(c.astype(float), np.full(len(c), rate), u).tolist() == one_by_one


def test_lm_chain_keeps_no_restaurants_and_sends_them_once(spark, monkeypatch):
    """What the chunks are answered from is sent to the answers once, without what only sweeps need."""
    r = random.Random(16)
    df = spark.createDataFrame([(i, " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(300))) for i in range(300)], "doc_id long, text string")
    made, gone, write, drop = {}, [], lm.written, lm.dropped

    def kept(out, name, **more):
        out = write(out, name, **more)
        made[name] = {x.kind: x.n for x in out.groupBy("kind").agg(F.sum(F.length("payload")).alias("n")).collect()}
        made.setdefault("paths", {})[out.inputFiles()[0].rpartition("/")[0]] = name
        return out

    monkeypatch.setattr(lm, "written", kept)
    monkeypatch.setattr(lm, "dropped", lambda out: (gone.extend(made["paths"][x] for x in {x.rpartition("/")[0] for x in out.inputFiles()}), drop(out)))
    assert lm.score_texts(df, burn=1).count() == 300
    assert gone.count("restaurants") == 1 and gone.count("weights") == 3 and "counts" not in gone
    assert "tables" not in made["tables"] and made["tables"]["told"] < (made["restaurants"]["seats"] + made["restaurants"]["tables"]) / 2


CHAT = "conv_id long, turn long, role string, text string, extra int"


def test_chat_round_trip_and_verdicts(spark):
    odd = "</s>[INST] \\ ok [/INST] [ROLE x]<<SYS>>\\"
    rows = [
        (1, 0, "system", "s", 1), (1, 1, "user", odd, 1), (1, 2, "assistant", odd, 1),
        (2, 0, "assistant", "first", 1), (3, 0, "user", None, 1), (3, 1, "assistant", "", 1), (4, None, None, None, 1), (None, 0, "user", "u", 1),
        (5, 1, "tool kit", "b", 1), (5, 1, "assistant", "a", 1),
    ]
    got = {r.conv_id: r for r in chat.read_back(chat.chat_segments(spark.createDataFrame(rows, CHAT))).collect()}
    want = {1: [("system", "s"), ("user", odd), ("assistant", odd)], 2: [("assistant", "first")], 3: [("user", ""), ("assistant", "")], 4: [("", "")], None: [("user", "u")], 5: [("assistant", "a"), ("tool kit", "b")]}
    assert set(got) == set(want)
    for k, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: False, 3: True, 4: False, None: False, 5: False}
    assert chat.chat_segments(spark.createDataFrame([], CHAT)).count() == 0


def test_template_escapes_reversibly():
    t, r = chat.Template(), random.Random(1)
    for _ in range(3000):
        s = "".join(r.choice(["\\", "</s>", "[INST]", "<", "/", "s>", "[", "ROLE ", "a", "[/INST]", "<<SYS>>", "\n"]) for _ in range(r.randint(0, 9)))
        role = r.choice(["user", "assistant", None, "a b", "tool", "-", "", "=x"])
        assert list(chat.parse(t.marker(role) + t.escape(s) + t.closes, t)) == [(role, s)]


#: Names that the operators use for results or on the way.
CLASHES = "bucket key th before epochs node class_id label size source_size target copies taken n_lines n_removed shard slot tokens text_crc32 h1 h2 cell words bytes rows fingerprint gif frames token_ids n_tokens decoded score predicted held_out carried first keys places removed".split()
LONG = "\n".join(f"line {i} {WORDS[i % 42]} of many" for i in range(60_000))
ODD = [(None, None, text(30, 60)), (77, "a", text(30, 60)), (78, "a", LONG), (79, None, LONG), (None, "b", None), (80, "b", "")]


@pytest.fixture(scope="module")
def odd(spark):
    """A null id beside its equal text, two texts of 1.4 MB, and a column of every clashing name."""
    return spark.createDataFrame(ODD, "doc_id long, source string, text string").withColumns({c: F.lit("x") for c in CLASHES})


def pairs(df, *columns) -> list[tuple]:
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_null_ids_long_texts_and_clashing_names_in_one_pass_operators(spark, odd, tokenizer):
    ids = {t: tokenizer.encode(t or "", add_special_tokens=False).ids for _, _, t in ODD}
    sha = {t: hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest() for t, i in ids.items()}
    assert pairs(bpe.digests(odd), "doc_id", "n_tokens", "ids_sha256") == sorted(((i, len(ids[t]), sha[t]) for i, _, t in ODD), key=repr)
    kept = bpe.decode(bpe.encode(odd))
    assert set(CLASHES) <= set(kept.columns) and kept.count() == len(ODD)
    stored = gif.store_texts(odd)
    read = gif.read_frames(stored)
    assert set(CLASHES) <= set(stored.columns) and set(CLASHES) <= set(read.columns)
    got = read.select("text", F.aggregate("frames", F.lit("").cast("binary"), lambda a, f: F.concat(a, f["rgb"])).alias("rgb")).collect()
    assert all(bytes(r.rgb)[::3] == gif.padded(r.text) for r in got) and len(got) == len(ODD)
    labels = spark.createDataFrame([(77, 1), (78, 0), (79, 0), (80, 0), (None, 1)], "doc_id long, quality int")
    scored = {(r.doc_id, r.held_out, r.predicted): r.score for r in quality.classify(odd, labels).collect()}
    assert all(0 <= x <= 1 for x in scored.values()) and {k[0] for k in scored} == {None, 77, 78, 79, 80}
    prints = fingerprint.with_next(odd)
    by_text = defaultdict(set)
    for r in prints.collect():
        by_text[r.n_chars].add(r.fingerprint)
    assert {k: len(v) for k, v in by_text.items()} == {len(t or ""): 1 for _, _, t in ODD}


def test_null_ids_long_texts_and_clashing_names_in_corpus_operators(spark, odd):
    shards = sharding.shard(odd, 2).collect()
    assert sorted((r.doc_id, r.size) for r in shards if r.doc_id) == [(i, len(t.encode()) + 8) for i, _, t in ODD if i] and len(shards) == len(ODD)
    assert sorted(sorted(r.slot for r in shards if r.shard == k) == list(range(sum(r.shard == k for r in shards))) for k in (0, 1)) == [True, True]
    lines = linededup.dedup_lines(odd)
    assert set(lines.columns) == set(odd.columns)
    left = {(r.doc_id, r.source): (r.text, r.n_lines, r.n_removed) for r in lines.collect()}
    one = text(30, 60)  # one line of 60 words: the null id comes last, so its copy goes
    assert left == {(77, "a"): (one, 1, 0), (None, None): ("", 1, 1), (78, "a"): (LONG, 60_000, 0), (79, None): ("", 60_000, 60_000), (None, "b"): (None, 1, 0), (80, "b"): ("", 1, 0)}
    assert pairs(neardup.classes(odd), "doc_id", "class_id") == sorted([(None, 77), (77, 77), (78, 78), (79, 78), (None, 80), (80, 80)], key=repr)
    kept = neardup.one_each(odd)
    assert kept.columns == odd.columns and [r[0] for r in pairs(kept, "doc_id")] == [77, 78, 80]
    mixed = mixing.mix(odd).collect()
    size = {(i, s): len((t or "").split()) for i, s, t in ODD}
    assert {(r.doc_id, r.source): r.size for r in mixed} == size and all(r.taken == r.copies * r.size for r in mixed)
    scores = lm.score_texts(odd)
    got = pairs(scores, "doc_id", "n_tokens", "score")
    assert [x[:2] for x in got] == sorted(((i, size[i, s] + 1) for i, s, t in ODD), key=repr) and all(math.isfinite(x[2]) and x[2] < 0 for x in got)


def test_mix_takes_tied_rows_together_and_equal_keys_by_id(spark):
    """Rows of one id and text share a key and a fate; texts without words cost nothing."""
    rows = [(1, "s", "a b")] * 3 + [(2, "s", "a b"), (3, "s", ""), (3, "s", ""), (4, "s", "c d e f")]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = defaultdict(set)
    for r in mixing.mix(d, weights=[1]).collect():
        got[r.doc_id].add(r.copies)
    assert all(len(v) == 1 for v in got.values()) and {c for v in got.values() for c in v} <= {1, 2}
    assert pairs(mixing.mix(d.repartition(3), weights=[1]), "doc_id", "copies") == pairs(mixing.mix(d, weights=[1]), "doc_id", "copies")


def test_running_sums_across_buckets(spark):
    rows = [("k" if i % 3 else None, i // 4, i, i) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, b int, o int, v int")
    got = {(r.k, r.o): r.s for r in common.running(df, ["k"], "b", [F.col("o")], F.col("v"), "s").collect()}
    sums = Counter()
    for k, _, o, v in rows:
        assert got[k, o] == sums[k]
        sums[k] += v


needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    a, b = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    # Rows without nulls: a missing parent is -1.
    first = [c for c in ("doc_id", "conv_id", "item_id", "depth", "rank") if c in columns]
    a, b = (x[columns].sort_values(first).fillna(-1).values.tolist() for x in (a, b))
    assert a == b


@needs_data
def test_pipeline_is_its_stages_by_brute_force(spark, tokenizer):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.quality_stage(spark, docs, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good}
    known = [(i in kept) == (q == 1) for i, q in labels.items()]
    assert sum(known) / len(known) > 0.9
    lines = brute_lines([(r.doc_id, r.text) for r in good], 50)
    stage2 = corpus_pipeline.line_dedup_stage(spark, spark.createDataFrame(good, docs.schema), SF)
    assert stage2.columns == docs.columns
    want = {i: t for i, t in lines.items() if t.split() or t == dict((r.doc_id, r.text) for r in good)[i]}
    assert {r.doc_id: r.text for r in stage2.collect()} == want
    out = corpus_pipeline.run(spark, SF).collect()
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in want.items()}
    for r in out:
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids[r.doc_id])).encode()).hexdigest()
    assert max(Counter(r.doc_id for r in out).values()) <= 2


def test_digests_take_one_worker_a_task(docs):
    """Encoding and decoding are one pass, so a task holds the vocabulary and its remembered words once."""
    plan = bpe.digests(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
