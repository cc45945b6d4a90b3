"""BPE encoding by backtracking over the matches of an Aho-Corasick automaton, and decoding through an offset table.

A word is a string of symbols: its bytes, the last one marked as the word's end. The automaton holds the
tokens from their last symbol to their first; one pass over the word from its end, along failure links,
so finds the longest token that starts at each place. Tokens are then laid left to right; one may follow
another only if the merge rules would leave the border between the two alone (`stands`), which the rank
table of pairs decides. Where nothing fits, the last token gives way to its longest prefix that is a
token, and a place found dead is not tried again, so the work is linear in the word.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns

BASE = 512  # symbols: 256 bytes inside a word, 256 bytes that end one
#: Distinct chunks of text whose ids a worker remembers, in each of two generations.
REMEMBERED = 200_000


# What Unicode added after version 15.1, which Python's tables may lack and the tokenizers library has.
#: Letters and numbers of Unicode 16.0 (first, last).
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: Lower case of Unicode 16.0 and 17.0 (first capital, last capital, first small letter).
LOWER_17 = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]
#: Combining marks that the library's composition tables, older than its patterns, take for letters of their own, and the one
#: letter (U+11930) that they don't compose.
APART = [
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715),
    (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85),
    (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34),
    (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F),
    (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
    (0x11930, 0x11930),
]
_APART = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in APART) + "])")
SMALL = {a + i: c + i for a, b, c in LOWER_17 for i in range(b - a + 1)}


def composed(text: str) -> str:
    """NFC as the library has it: what it doesn't know as a mark neither moves nor lets other marks past."""
    if not _APART.search(text):
        return unicodedata.normalize("NFC", text)
    return "".join(x if i % 2 else unicodedata.normalize("NFC", x) for i, x in enumerate(_APART.split(text)))


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself where printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """The tables of one word-end BPE vocabulary, from its tokenizers JSON."""

    def __init__(self, raw: bytes) -> None:
        import regex

        spec = json.loads(raw)
        model, mark = spec["model"], spec["model"]["end_of_word_suffix"]
        letters = byte_letters()
        ids = model["vocab"]
        names = [*letters, *(x + mark for x in letters)]
        place = {x: i for i, x in enumerate(names)}
        self.left, self.right = list(range(BASE)), list(range(BASE))
        self.pairs: dict[tuple[int, int], int] = {}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        for a, b in merges:
            pair, name = (place[a], place[b]), a + b
            t = place.setdefault(name, len(names))
            if t == len(names):
                names.append(name)
                self.left.append(pair[0])
                self.right.append(pair[1])
            self.pairs.setdefault(pair, t)
        back = {x: i for i, x in enumerate(letters)}
        code = lambda name: "".join(chr(back[c]) for c in name) if not name.endswith(mark) else "".join(chr(back[c]) for c in name[: -len(mark)][:-1]) + chr(256 + back[name[: -len(mark)][-1]])
        spelt = [code(x) for x in names]
        self.length = [len(x) for x in spelt]
        reached = [True] * BASE
        for t in range(BASE, len(names)):
            reached.append(reached[self.left[t]] and reached[self.right[t]] and self.stands(self.left[t], self.right[t], t))
        self.goto, self.fail, self.best = automaton((x[::-1], t) for t, x in enumerate(spelt) if reached[t])
        self.known: dict[int, bool] = {}
        where = {x: t for t, x in enumerate(spelt) if reached[t]}
        self.shorter: list[int | None] = [next((where[x[:k]] for k in range(len(x) - 1, 0, -1) if x[:k] in where), None) for x in spelt]
        self.ids = [ids[x] for x in names]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pieces = regex.compile(as_of_16(pattern), regex.V1)
        # Offset table: the shown form of token i is text[offsets[i]:offsets[i + 1]].
        shown = {**{i: x for x, i in ids.items()}, **{i: x for x, i in self.special.items()}}
        parts = [shown.get(i, "").encode() for i in range(max(shown) + 1)]
        self.text = np.frombuffer(b"".join(parts) + b" ", np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        self.words: dict[str, list[int]] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def stands(self, a: int, b: int, bound: int = 1 << 40) -> bool:
        """Whether merging by rank, below `bound`, leaves tokens a and b side by side.

        The two are taken apart again, the later-made one first; the border fails if the pieces that
        face each other at some time would have merged before the piece that then grew. Equal ranks
        merge from the left, hence the one more for the right-hand token.
        """
        while True:
            joined = self.pairs.get((a, b))
            if joined is not None and joined < bound:
                return False
            if a < BASE and b < BASE:
                return True
            if a > b:
                bound, a = min(bound, a), self.right[a]
            else:
                bound, b = min(bound, b + 1), self.left[b]

    def longest(self, data: bytes) -> list[int | None]:
        """The longest token that starts at each place of a word: one pass of the automaton from the word's end."""
        goto, fail, best = self.goto, self.fail, self.best
        out: list[int | None] = []
        state, symbol = 0, 256
        for byte in reversed(data):
            symbol += byte
            to = goto.get(state << 9 | symbol)
            while to is None and state:
                state = fail[state]
                to = goto.get(state << 9 | symbol)
            state = to or 0
            out.append(best[state])
            symbol = 0
        out.reverse()
        return out

    def word(self, data: bytes) -> list[int]:
        """Ids of one word."""
        n = len(data)
        if not n:
            return []
        longest = self.longest(data)
        length, known = self.length, self.known
        out: list[int] = []
        dead: set[int] = set()  # places from which the rest can't be spelt
        at = last = 0
        while at < n:
            t = longest[at]
            while True:
                if t is not None:
                    end = at + length[t]
                    fits = end not in dead
                    if fits and out:
                        pair = last << 17 | t
                        fits = known.get(pair)
                        if fits is None:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            fits = known[pair] = self.stands(last, t)
                    if fits:
                        out.append(t)
                        at, last = end, t
                        break
                    t = self.shorter[t]
                    continue
                if not out:
                    raise ValueError("the vocabulary can't spell this word")
                dead.add(at)
                t = out.pop()
                last = out[-1] if out else 0
                at -= length[t]
                t = self.shorter[t]
        ids = self.ids
        return [ids[t] for t in out]

    def chunk(self, chunk: str) -> list[int]:
        """Ids of a text without white space."""
        out: list[int] = []
        for part in self.split_special.split(chunk) if self.split_special and "<|" in chunk else [chunk]:
            if part in self.special:
                out.append(self.special[part])
                continue
            # Letters are lowered one by one, so the word-final form of sigma is not used.
            part = part.lower() if part.isascii() else composed(part).replace("Σ", "σ").lower().translate(SMALL)
            if part.isalpha():
                out += self.known_word(part)
            elif part[:-1].isalpha() and part[-1] in ".,;:!?":
                out += self.known_word(part[:-1])
                out += self.known_word(part[-1])
            else:
                for piece in self.pieces.findall(part):
                    out += self.known_word(piece)
        return out

    def known_word(self, piece: str) -> list[int]:
        got = self.words.get(piece)
        if got is None:
            got = self.word(piece.encode())
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            if len(piece) <= 64:
                self.words[piece] = got
        return got

    def remembered(self, chunk: str) -> bytes:
        got = self.old.get(chunk)
        if got is None:
            got = array("i", self.chunk(chunk)).tobytes()
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        if len(chunk) <= 64:
            self.young[chunk] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        words = text.split() if not _INFO.search(text) else _SPACE.split(text)
        young, more = self.young, self.remembered
        found = list(map(young.get, words))
        if None in found:
            found = [more(w) if x is None else x for w, x in zip(words, found, strict=True)]
        return np.frombuffer(b"".join(found), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The shown tokens with a blank between each two, gathered through the offset table."""
        if not len(ids):
            return ""
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start + 1  # one more for the blank
        ends = np.cumsum(size)
        take = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
        take[ends - 1] = len(self.text) - 1
        return self.text[take[:-1]].tobytes().decode()


#: U+001C to U+001F are white space for str.split() but not for the vocabulary's patterns.
_INFO = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def automaton(words: Iterable[tuple[str, int]]) -> tuple[dict[int, int], list[int], list[int | None]]:
    """An Aho-Corasick automaton: goto by state << 9 | symbol, failure links, and each state's longest word that ends there."""
    goto: dict[int, int] = {}
    above, symbols, best = [0], [0], [None]
    for word, value in words:
        state = 0
        for symbol in map(ord, word):
            to = goto.get(state << 9 | symbol)
            if to is None:
                to = goto[state << 9 | symbol] = len(above)
                above.append(state)
                symbols.append(symbol)
                best.append(None)
            state = to
        best[state] = value
    depth = [0] * len(above)
    for state in range(1, len(above)):  # made after what is above it
        depth[state] = depth[above[state]] + 1
    fail = [0] * len(above)
    for state in sorted(range(1, len(above)), key=depth.__getitem__):
        if depth[state] > 1:
            back, to = above[state], None
            while to is None and back:
                back = fail[back]
                to = goto.get(back << 9 | symbols[state])
            fail[state] = to or 0
        if best[state] is None:
            best[state] = best[fail[state]]
    return goto, fail, best


def as_of_16(pattern: str) -> str:
    r"""`pattern` with \p{L} and \p{N} as of Unicode 16.0, as the tokenizers library has them; the regex library's tables are newer."""
    import regex

    known = [*LETTERS_16, *NUMBERS_16]
    spans: list[list[int]] = []
    for plane in range(0, 0x110000, 1 << 16):
        for x in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, range(plane, plane + (1 << 16))))):
            c = ord(x)
            if unicodedata.category(x) != "Cn" or any(a <= c <= b for a, b in known):
                continue
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    less = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)
    return pattern.replace(r"\p{L}", rf"[\p{{L}}--[{less}]]").replace(r"\p{N}", rf"[\p{{N}}--[{less}]]") if spans else pattern


@functools.lru_cache(maxsize=2)
def vocabulary(packed: bytes) -> Vocabulary:
    return Vocabulary(zlib.decompress(packed))


def vocabulary_file(spark: SparkSession, path: str | None = None):  # noqa: ANN201
    """The vocabulary's file as a broadcast (under 4 MB however large the corpus); read on the driver alone."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(zlib.compress(f.read(), 6))


def lists_of(arrays: Iterable[np.ndarray]) -> pa.Array:
    arrays = list(arrays)
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays])))


def encode(df: DataFrame, column: str = "text", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """`df` with token_ids array<int>: the whole text's ids, special tokens in the text included.

    Null and empty texts get an empty list. Texts of any length are encoded whole; columns of `df`
    named token_ids are replaced; an empty table stays empty.
    """
    file = vocabulary_file(df.sparkSession, path)
    new = T.StructType([T.StructField("token_ids", T.ArrayType(T.IntegerType()))])

    def run(texts: list) -> tuple:
        v = vocabulary(file.value)
        return (lists_of(v.encode(x or "") for x in texts),)

    return add_columns(df, column, new, run, keep)


def decode(df: DataFrame, column: str = "token_ids", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """`df` with decoded string: the shown tokens of `column` joined by blanks; a null list is empty."""
    file = vocabulary_file(df.sparkSession, path)
    new = T.StructType([T.StructField("decoded", T.StringType())])

    def run(lists: pa.ListArray) -> tuple:
        v = vocabulary(file.value)
        ids, ends = np.asarray(lists.flatten()).astype(np.int64), np.cumsum(pc.fill_null(pc.list_value_length(lists), 0))
        return ([v.decode(ids[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)],)

    return add_columns(df, column, new, run, keep, raw=True)


def digests(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: what `encode` and then `decode` give."""
    file = vocabulary_file(docs.sparkSession, path)
    new = T.StructType([T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(texts: list) -> tuple:  # one worker a task does both, so that a task holds the vocabulary once
        v = vocabulary(file.value)
        ids = [v.encode(x or "") for x in texts]
        return lists_of(ids), [v.decode(x) for x in ids]

    both = add_columns(docs.select("doc_id", text_col), text_col, new, run, ["doc_id"])
    ids_sha256 = F.sha2(F.array_join("token_ids", " "), 256).alias("ids_sha256")
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), ids_sha256, F.sha2("decoded", 256).alias("decoded_sha256"))


def tokens(texts: Iterator[str], path: str) -> Iterator[list[int]]:
    """Ids of texts outside Spark, for tests and small uses."""
    with open(path, "rb") as f:
        v = Vocabulary(f.read())
    for x in texts:
        yield v.encode(x).tolist()
