"""LM scoring by a hierarchical Pitman-Yor bigram model, trained and applied without a broadcast model.

Texts become chunks of local word numbers, written once. Words are counted and numbered over all of them
first: their shares are the parent's probabilities when contexts are seated first. Each chunk sends the bigrams it
holds, whether to learn from or to score, to the bucket of their context; there the context's restaurant is
seated by Gibbs, and what each bigram's customers and each context's tables weigh goes back to the
chunk. The tables a word has in all contexts are its customers in the restaurant that all contexts share
as parent; words are dealt the same way. A chunk then has all it needs to add up its texts.

With `burn` the sweeps are a Markov chain over both levels, whose law is the exact posterior of all tables. Given a gamma
variable of shape strength / d + tables, a restaurant's dishes are independent of one another: a sweep draws it from
the tables of the sweep before, then all dishes. Given the parent's probabilities contexts are independent, too; so
these are drawn as well (the parent is a normalised stable process: each word weighs a gamma variable for its customers
and a tempered stable one for the shared base), go to the contexts, and the contexts' tables come back as customers.
Between sweeps a context keeps its number of tables alone, so only words with a dish of several customers travel.

Draws come from hashes of what they decide, and all that a restaurant needs besides its own customers
are sums over the corpus, so scores don't depend on chunks, buckets or partitions.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bagminhash import U64, mixed, uniform
from .common import bucketed, dropped, small_batches, text_of, written

#: Characters of text in a chunk, tokens a bucket is meant for, and Gibbs sweeps that are averaged.
CHUNK_CHARS, BUCKET_TOKENS, SWEEPS = 8 << 20, 1 << 20, 3
#: Sweeps of the chain before those that are averaged.
BURN = 1
#: Customers of a dish up to which the weights of its numbers of tables come from their recursion.
EXACT = 512
STRENGTH, DISCOUNT = 1.0, 0.75
END_HASH = 0x1F0E3D5C7B9A6857
GOLD = U64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    def __missing__(self, key: bytes) -> int:
        n = self[key] = len(self)
        return n


CHUNK = "chunk long, doc_ids array<long>, train array<boolean>, lengths binary, tokens binary, vocabulary binary, n long"


def stored(tokens: np.ndarray) -> bytes:
    return len(tokens).to_bytes(8, "little") + pa.compress(turned(tokens.astype(np.int32)), "zstd", asbytes=True)


def tokens_of(row: dict) -> np.ndarray:
    n = int.from_bytes(row["tokens"][:8], "little")
    return returned(pa.decompress(memoryview(row["tokens"])[8:], 4 * n, "zstd"), np.int32)


def chunks(docs: DataFrame, held: str) -> DataFrame:
    """Chunks of texts as numbers into the chunk's own vocabulary of 64-bit word hashes, where number 0 is the end.

    `docs` is (doc_id, text, `held`: held out). Words are what space and \\x09-\\x0D separate, A-Z lowered.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("lengths", pa.binary()), ("tokens", pa.binary()), ("vocabulary", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        ids, train, parts, numbers, chars = [], [], [], _Numbers({b" ": 0}), 0

        def flush() -> pa.RecordBatch:
            vocabulary = np.array([END_HASH, *(xxhash.xxh64_intdigest(w) for w in list(numbers)[1:])], U64)
            lengths = np.array([len(p) for p in parts], np.int32)
            row = [[part << 24 | no], [ids], [train], [lengths.tobytes()], [stored(np.concatenate(parts))], [vocabulary.tobytes()], [int(lengths.sum())]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for i, text, out in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = text.encode("utf-8", "surrogatepass").lower().split()
                words.append(b" ")  # the end
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                ids.append(i)
                train.append(not out)
                chars += len(text)
                if chars >= CHUNK_CHARS:
                    yield flush()
                    no += 1
                    ids, train, parts, numbers, chars = [], [], [], _Numbers({b" ": 0}), 0
        if ids:
            yield flush()

    return docs.select("doc_id", "text", held).mapInArrow(run, CHUNK)


class Chunk:
    """A chunk's tokens and its distinct bigrams, in the order in which they are sent: by bucket, context, word."""

    def __init__(self, row: dict, buckets: int, hot: dict[int, int]) -> None:
        self.lengths = np.frombuffer(row["lengths"], np.int32)
        self.tokens = tokens_of(row).astype(np.int64)
        self.hashes = np.frombuffer(row["vocabulary"], U64)
        self.train = np.repeat(np.array(row["train"], bool), self.lengths)
        size = len(self.hashes)
        before = np.concatenate([[0], self.tokens[:-1]])  # each text ends with 0, which so stands before the next
        pair, self.of = np.unique(before * size + self.tokens, return_inverse=True)
        u, w = pair // size, pair % size
        count = np.bincount(self.of[self.train], minlength=len(pair))
        split = np.ones(size, np.int64)
        for i in np.flatnonzero(np.isin(self.hashes, np.array(list(hot), U64))) if hot else ():
            split[i] = hot[int(self.hashes[i])]
        part = mixed(self.hashes[w]) % split[u].astype(U64)
        bucket = ((mixed(self.hashes[u] + U64(5)) + part) % U64(buckets)).astype(np.int64)
        rank = np.unique(self.hashes, return_inverse=True)[1]  # hashes rise with the words' numbers
        if buckets * size * size < 1 << 63:
            order = np.argsort((bucket * size + rank[u]) * size + rank[w], kind="stable")
        else:
            order = np.lexsort((rank[w], rank[u], bucket))
        self.order, self.split = order, split
        self.u, self.w, self.count, self.bucket = u[order], w[order], count[order], bucket[order]
        self.word_order, self.word_bucket = by_place(self.hashes, buckets)

    def bounds(self, buckets: np.ndarray) -> list[tuple[int, int, int]]:
        """(bucket, first, end) of a sorted column of buckets."""
        values, first = np.unique(buckets, return_index=True)
        return list(zip(values.tolist(), first.tolist(), [*first[1:].tolist(), len(buckets)], strict=True))

    def sent(self, number: np.ndarray, share: np.ndarray, types: dict[int, int]) -> Iterator[tuple[int, bytes]]:
        """For each bucket: contexts, run lengths and known dishes; then of each bigram its word, its count, its word's share of the corpus."""
        share = np.clip(np.rint(-2048 * np.log2(share)), 0, 65535).astype(np.int64)
        dishes = np.zeros(len(number), np.int64)
        for i in np.flatnonzero(self.split > 1):
            dishes[i] = types.get(int(self.hashes[i]), 0) + 1
        for b, i, j in self.bounds(self.bucket):
            u, runs = np.unique(self.u[i:j], return_index=True)
            first = np.sort(runs)
            u = self.u[i:j][first]
            head = np.array([len(u), j - i], np.uint32).tobytes()
            contexts = planes(number[u], 5) + planes(np.diff([*first, j - i]), 4) + planes(dishes[u], 5)
            yield b, head + contexts + planes(number[self.w[i:j]], 5) + planes(share[self.w[i:j]], 2) + planes(self.count[i:j], 5)


def by_place(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of words by hash and, in that order, their buckets, each a range of hashes."""
    order = np.argsort(hashes)
    return order, (((hashes[order] >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)


def planes(x: np.ndarray, k: int) -> bytes:
    """The lowest k bytes of each number, first all the lowest, so that what is mostly zero is packed well."""
    return np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :k].T).tobytes()


def numbers(data: bytes, n: int, k: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :k] = np.frombuffer(data, np.uint8, n * k, at).reshape(k, n).T
    return out.view(np.int64).ravel()


def turned(x: np.ndarray) -> bytes:
    """The numbers' bytes, first the first of each: as `planes`, for any type."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def returned(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def steps(x: np.ndarray) -> bytes:
    """Numbers that mostly rise by little, as differences (mod 2^32)."""
    return turned(np.diff(x.astype(np.uint32), prepend=np.uint32(0)))


def summed_up(data: bytes) -> np.ndarray:
    return np.cumsum(returned(data, np.uint32), dtype=np.uint32).astype(np.int64)


def few_bytes(code: np.ndarray, value: np.ndarray) -> bytes:
    """A byte of each `code`, which says all below 255; of the others `value` in four bytes each."""
    return code.astype(np.uint8).tobytes() + value[code == 255].astype(np.float32).tobytes()


def opened(data: bytes) -> tuple[np.ndarray, ...]:
    """What `sent` packed: context of each bigram, its known dishes (one more; 0: not split), word, share, count; and first row of each context."""
    n_u, n = np.frombuffer(data, np.uint32, 2).tolist()
    u, length, dishes = numbers(data, n_u, 5, 8), numbers(data, n_u, 4, 8 + 5 * n_u), numbers(data, n_u, 5, 8 + 9 * n_u)
    at = 8 + 14 * n_u
    rest = (numbers(data, n, 5, at), numbers(data, n, 2, at + 5 * n), numbers(data, n, 5, at + 7 * n))
    return np.repeat(u, length), np.repeat(dishes, length), *rest, np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of numbers from 0.1 on, by Stirling's series."""
    low = sum(np.log(x + k) for k in range(8))
    x = x + 8
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) - low


@functools.lru_cache(maxsize=1)
def ways() -> np.ndarray:
    """Row c, column t - 1: the log of generalised Stirling numbers, the weight of c customers at t tables, less a number of c.

    The weight S(c, t) is S(c - 1, t - 1) + (c - 1 - d t) S(c - 1, t); kept is S(c, t) Gamma(t) d^(t - 1), scaled by row.
    """
    d, table = DISCOUNT, np.full((EXACT + 1, EXACT), -np.inf)
    a = np.zeros(EXACT, np.longdouble)
    a[0] = 1
    t = np.arange(1, EXACT + 1)
    table[1, 0] = 0
    for n in range(1, EXACT):
        more = d * (t[1:] - 1) * a[:-1]
        a *= np.maximum(n - d * t, 0)
        a[1:] += more
        a /= n - d
        table[n + 1, : n + 1] = np.log(a[: n + 1])
    return table - log_gamma(t.astype(float)) - (t - 1) * np.log(d)


def _ways_of_many(c: int, t: np.ndarray) -> np.ndarray:
    """The same for many customers, less another number of c, from the generating function (1 - (1 - x)^d)^t / (d^t t!).

    Its coefficient of x^c is an integral around the cut from x = 1, taken on a Talbot contour in
    s = c (1 - x); where t is far above c^d the contour's ends cancel, and the saddle point serves.
    """
    few = t <= 2 * c**DISCOUNT
    return np.concatenate([_around_cut(c, t[few]), _at_saddle(c, t[~few])]) - t * np.log(DISCOUNT) - log_gamma(t + 1.0)


@functools.lru_cache(maxsize=1)
def _contour() -> tuple[np.ndarray, np.ndarray]:
    m = 24
    theta = np.arange(1, m) * np.pi / m
    cot = 1 / np.tan(theta)
    return np.concatenate([[1 + 0j], theta * (cot + 1j)]) * 2 * m / 5, np.concatenate([[0.5 + 0j], 1 + 1j * (theta + (theta * cot - 1) * cot)])


def _around_cut(c: int, t: np.ndarray) -> np.ndarray:
    s, turn = _contour()
    one = turn * np.exp(-(c + 1) * np.log1p(-s / c))
    # The constant 1 of (1 - (s / c)^d)^t has no share in the integral.
    rest = np.expm1(t[:, None] * np.log1p(-((s / c) ** DISCOUNT)))
    return np.log(np.maximum(-(rest * one).real.sum(axis=1) * -2 / 5 / c, 1e-300))


def _at_saddle(c: int, t: np.ndarray) -> np.ndarray:
    if not len(t):
        return t
    d, ratio = DISCOUNT, c / t
    z = np.log(d / ratio) / (1 - d)  # of y = 1 - x
    for _ in range(40):
        y = np.exp(z)
        f = 1 - y**d
        g = np.log((1 - y) * d) + (d - 1) * z - np.log(f) - np.log(ratio)
        slope = -y / (1 - y) + d - 1 + d * y**d / f
        z = np.minimum(z - np.clip(g / slope, -2, 2), -1e-12)
        if np.abs(g).max() < 1e-11:
            break
    y = np.exp(z)
    x, f = 1 - y, 1 - y**d
    h = x * d * y ** (d - 1) / f
    spread = t * h * (1 + x * (1 - d) / y - h)  # x dh/dx
    return t * np.log(f) - c * np.log(x) - 0.5 * np.log(2 * np.pi * spread)


def _drawn_of_many(c: int, weight: Callable[[np.ndarray], np.ndarray], u: np.ndarray) -> np.ndarray:
    """Tables of a dish of many customers, for each of the uniform numbers `u`: the law where it isn't negligible.

    `weight`: log of what t tables weigh beside their Stirling number.
    """
    law_of = lambda t: _ways_of_many(c, t) + weight(t)
    grid = np.unique(np.rint(np.geomspace(1, c - 1, 256)))
    law = law_of(grid)
    near = np.flatnonzero(law > law.max() - 40)
    t = np.arange(grid[max(near[0] - 1, 0)], grid[min(near[-1] + 1, len(grid) - 1)] + 1)
    law = law_of(t)
    total = np.cumsum(np.exp(law - law.max()))
    return t[np.minimum(np.searchsorted(total, u * total[-1]), len(t) - 1)].astype(np.int64)


def _law_of_each(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """`_ways_of_many` of dishes of many customers each: row i is of c[i] customers at the tables t[i]."""
    rows, columns = np.nonzero(t <= 2 * c[:, None] ** DISCOUNT)
    out, z = np.empty(t.shape), _contour()
    with np.errstate(divide="ignore"):
        turn = np.log1p(-((z[0] / c[:, None]) ** DISCOUNT))[rows]
    weight = (z[1] * np.exp(-(c[:, None] + 1) * np.log1p(-z[0] / c[:, None])))[rows]
    real, angle = t[rows, columns, None] * turn.real, t[rows, columns, None] * turn.imag
    part = np.expm1(real) * np.cos(angle) - 2 * np.sin(angle / 2) ** 2  # real part of exp - 1
    found = (part * weight.real - np.exp(real) * np.sin(angle) * weight.imag).sum(axis=1)
    out[rows, columns] = np.log(np.maximum(found * 2 / 5 / c[rows], 1e-300))
    rows, columns = np.nonzero(t > 2 * c[:, None] ** DISCOUNT)
    if len(rows):
        out[rows, columns] = _at_saddle(c[rows], t[rows, columns])
    return out - t * np.log(DISCOUNT) - log_gamma(t + 1.0)


def _drawn_of_each(c: np.ndarray, rate: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Tables of dishes of many customers each, where t tables weigh S(c, t) exp(t * rate): the laws where they aren't negligible.

    A law has one peak, so what is not negligible lies between the points of ever finer grids that are next to what is not.
    """
    rows, low, high = np.arange(len(c)), np.ones(len(c)), c - 1.0
    law_of = lambda t: _law_of_each(c, t) + t * rate[:, None]
    for k in range(3):
        part = np.linspace(0, 1, 16)
        t = np.rint(low[:, None] * (high / low)[:, None] ** part if not k else low[:, None] + (high - low)[:, None] * part)
        law = law_of(t)
        near = law > law.max(axis=1, keepdims=True) - 40
        first, last = near.argmax(axis=1), near.shape[1] - 1 - near[:, ::-1].argmax(axis=1)
        low, high = t[rows, np.maximum(first - 1, 0)], t[rows, np.minimum(last + 1, t.shape[1] - 1)]
    out, step = np.empty(len(c), np.int64), 1 << 10
    for i in range(len(c)):  # one law at a time, in pieces
        t = np.arange(low[i], high[i] + 1)
        law = np.concatenate([_law_of_each(c[i : i + 1], t[None, k : k + step])[0] for k in range(0, len(t), step)]) + t * rate[i]
        total = np.cumsum(np.exp(law - law.max()))
        out[i] = t[min(int(np.searchsorted(total, u[i] * total[-1])), len(t) - 1)]
    return out


def seated(count: np.ndarray, others: np.ndarray, share: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Tables of each dish at the first seating, summed over SWEEPS independent draws; every customer is seated. No chain: see `chained`.

    A draw takes all customers of a dish out and seats them again, given `others`, the restaurant's tables
    of other dishes: t tables have probability in proportion to S(c, t) times the weights with which they
    were opened, (strength + d * (others + i)) * share for i = 1 .. t - 1. Up to EXACT customers S is made
    by its recursion, beyond it is an integral (`_ways_of_many`).
    """
    out = np.where(count > 0, SWEEPS, 0).astype(np.int64)
    order = np.argsort(count, kind="stable")
    order = order[np.searchsorted(count[order], 2) :]
    if not len(order):
        return out
    values, first = np.unique(count[order], return_index=True)
    with np.errstate(over="ignore"):
        u = np.stack([uniform(mixed(key + U64(k + 1) * GOLD)) for k in range(SWEEPS)])
    for c, i, j in zip(values.tolist(), first, [*first[1:], len(order)], strict=True):
        if c > EXACT:
            for k in order[i:j].tolist():
                start, rate = STRENGTH / DISCOUNT + float(others[k]), np.log(float(share[k]) * DISCOUNT)
                out[k] = _drawn_of_many(c, lambda t, start=start, rate=rate: log_gamma(start + t) + t * rate, u[:, k]).sum()
            continue
        law, t, step = ways()[c, :c], np.arange(1, c), max(1, (1 << 19) // c)
        for a in range(i, j, step):
            own = order[a : min(j, a + step)]
            weight = np.log((STRENGTH + DISCOUNT * (others[own, None] + t)) * share[own, None])
            at = np.cumsum(np.concatenate([np.zeros((len(own), 1)), weight], axis=1), axis=1) + law
            at = np.cumsum(np.exp(at - at.max(axis=1, keepdims=True)), axis=1)
            out[own] = SWEEPS + sum((at < (u[k, own] * at[:, -1])[:, None]).sum(axis=1) for k in range(SWEEPS))
    return out


def drawn(count: np.ndarray, rate: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Tables of each dish, where t tables have probability in proportion to S(c, t) exp(t * rate)."""
    out = (count > 0).astype(np.int64)
    order = np.argsort(count, kind="stable")
    order = order[np.searchsorted(count[order], 2) :]
    if not len(order):
        return out
    values, first = np.unique(count[order], return_index=True)
    u = uniform(mixed(key))
    few = int(np.searchsorted(count[order], EXACT, "right"))
    for i in range(few, len(order), 64):
        own = order[i : i + 64]
        out[own] = _drawn_of_each(count[own].astype(float), rate[own], u[own])
    for c, i, j in zip(values.tolist(), first, [*first[1:], len(order)], strict=True):
        if c > EXACT:
            break
        law, t, step = ways()[c, :c], np.arange(1, c + 1), max(1, (1 << 19) // c)
        for a in range(i, j, step):
            own = order[a : min(j, a + step)]
            at = rate[own, None] * t + law
            at = np.cumsum(np.exp(at - at.max(axis=1, keepdims=True)), axis=1)
            out[own] = 1 + (at[:, :-1] < (u[own] * at[:, -1])[:, None]).sum(axis=1)
    return out


def keys(x: np.ndarray, y: np.ndarray | int, sweep: int, use: int) -> np.ndarray:
    """Hashes of what a draw decides: two numbers, the sweep, and what the draw is for."""
    with np.errstate(over="ignore"):
        return mixed(mixed(mixed(x.astype(U64) + U64(1)) * GOLD + np.asarray(y).astype(U64)) + U64(sweep << 8 | use) * GOLD)


def gammas(shape: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A gamma variable of each shape above 0, by Marsaglia and Tsang's rejection from hashes."""
    low = shape < 1
    d = np.where(low, shape + 1, shape) - 1 / 3
    out, left, k = np.empty(len(shape)), np.arange(len(shape)), 0
    while len(left):
        with np.errstate(over="ignore"):
            a, b, e = (uniform(mixed(key[left] + U64(k + i) * GOLD)) for i in (1, 2, 3))
        x = np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)
        v = np.maximum(1 + x / np.sqrt(9 * d[left]), 0) ** 3
        with np.errstate(divide="ignore", invalid="ignore"):
            ok = (v > 0) & (np.log(e) < x * x / 2 + d[left] * (1 - v + np.log(v)))
        out[left[ok]] = (d[left] * v)[ok]
        left, k = left[~ok], k + 3
    out[low] *= uniform(mixed(~key[low])) ** (1 / shape[low])
    return out


def tempered(mass: float, key: np.ndarray) -> np.ndarray:
    """Tempered stable variables: E exp(-s X) = exp(-mass ((1 + s)^d - 1)), as sums of pieces of mass up to 1.

    A piece is a stable variable by Kanter's formula, kept with probability exp(-x).
    """
    d, pieces, out = DISCOUNT, max(1, int(np.ceil(mass))), np.zeros(len(key))
    for piece in range(pieces):
        left, k = np.arange(len(key)), 0
        while len(left):
            with np.errstate(over="ignore"):
                a, b, e = (uniform(mixed(mixed(key[left] + U64(piece) * GOLD) + U64(k + i) * GOLD)) for i in (1, 2, 3))
            a *= np.pi
            x = (mass / pieces) ** (1 / d) * np.sin(d * a) / np.sin(a) ** (1 / d) * (np.sin((1 - d) * a) / -np.log(b)) ** ((1 - d) / d)
            ok = e < np.exp(-x)
            out[left[ok]] += x[ok]
            left, k = left[~ok], k + 3
    return out


def packed(*arrays: np.ndarray | bytes) -> bytes:
    arrays = tuple(np.frombuffer(a, np.uint8) if isinstance(a, bytes) else a for a in arrays)
    return b"".join(x for a in arrays for x in (np.array([ord(a.dtype.char), a.nbytes]).tobytes(), a.tobytes()))


def unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, size = np.frombuffer(data, np.int64, 2, at).tolist()
        dtype = np.dtype(chr(kind))
        out.append(np.frombuffer(data, dtype, size // dtype.itemsize, at + 16))
        at += 16 + size
    return out


def merged(rows: list[tuple[int, bytes]]) -> tuple:
    """Of what chunks sent to a bucket: each bigram's dish, each chunk's number of bigrams and first row of each context; and of each
    dish, by context and word: context, word, share, known dishes, customers."""
    parts = [opened(data) for _, data in rows]
    u, known, word, share, count = (np.concatenate([p[i] for p in parts]) for i in range(5))
    sizes, heads = [len(p[0]) for p in parts], [p[5] for p in parts]
    del parts
    if max(u.max(initial=0), word.max(initial=0)) < 1 << 31:
        order = np.argsort(u << 32 | word, kind="stable")  # of sorted runs
    else:
        order = np.lexsort((word, u))
    new = np.ones(len(order), bool)
    new[1:] = (u[order][1:] != u[order][:-1]) | (word[order][1:] != word[order][:-1])
    dish = np.empty(len(order), np.int64)
    dish[order] = np.cumsum(new) - 1
    first = order[new]
    return dish, sizes, heads, u[first], word[first], share[first], known[first], np.bincount(dish, count).astype(np.int64)


def by_bucket(numbers: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """(word bucket, first, end) of sorted word numbers."""
    b, first = np.unique(np.searchsorted(starts, numbers, "right") - 1, return_index=True)
    return list(zip(b.tolist(), first.tolist(), [*first[1:].tolist(), len(numbers)][: len(b)], strict=True))


def chained(state: bytes, tables: np.ndarray, log_p: np.ndarray, sweep: int) -> tuple[np.ndarray, np.ndarray]:
    """A sweep of a bucket's contexts: tables of each dish of several customers, and of each context.

    `tables` are each context's of the sweep before; t tables weigh S(c, t) p^t, and all T of a context
    d^T Gamma(strength / d + T), which is the mean of (d g)^T over a gamma variable g.
    """
    rooms, _, single, room, place, count, words = unpacked(state)
    g = gammas(STRENGTH / DISCOUNT + tables, keys(rooms, 0, sweep, 1))
    t = drawn(count, np.log(DISCOUNT * g)[room] + log_p[place], keys(rooms[room], words[place], sweep, 2))
    return t, single + np.bincount(room, t, len(rooms)).astype(np.int64)


def sent_up(bucket: int, state: bytes, t: np.ndarray, tables: np.ndarray, starts: np.ndarray, singles: dict[int, list] | None = None) -> Iterator[tuple[str, int, int, bytes, int]]:
    """After a sweep: ("up", word bucket, bucket, tables of the words), ("rooms", split contexts and their tables here), ("sums", tables)."""
    rooms, split, _, _, place, _, words = unpacked(state)
    of_word = np.bincount(place, t, len(words)).astype(np.int64)
    spans = {b: (i, j) for b, i, j in by_bucket(words, starts)}
    for b in sorted({*spans, *(singles or ())}):
        i, j = spans.get(b, (0, 0))
        more = [(words[i:j] - starts[b]).astype(np.int32), *singles.get(b, [np.zeros(0, np.int32)] * 2)] if singles is not None else []
        yield "up", b, bucket, packed(of_word[i:j].astype(np.uint32) if of_word[i:j].max(initial=0) < 1 << 32 else of_word[i:j], *more), 0
    yield "rooms", bucket, -1, rooms[split].tobytes() + tables[split].tobytes(), 0
    yield "sums", bucket, -1, b"", int(tables.sum())


def restaurants(rows: list[tuple[int, bytes]], bucket: int, starts: np.ndarray, kept: bool) -> Iterator[tuple[str, int, int, bytes, int]]:
    """What the chain keeps of a bucket, and its first sweep: from one table a dish, by the words' shares of the corpus."""
    dish, sizes, heads, u, word, share, known, customers = merged(rows)
    rooms, at, room = np.unique(u, return_index=True, return_inverse=True)
    known, many, one = known[at], np.flatnonzero(customers > 1), customers == 1
    code, number, a = np.minimum(np.where(customers > 1, 255, customers), 255).astype(np.uint8), np.cumsum(customers > 1) - 1, 0
    for (chunk, _), size, head in zip(rows, sizes, heads, strict=True):
        own = dish[a : a + size]
        a += size
        yield "asks", bucket, chunk, packed(code[own], steps(number[own][code[own] == 255]), steps(room[own[head]])), 0
    words, place = np.unique(word[many], return_inverse=True)
    state = packed(rooms, known > 0, np.bincount(room, one, len(rooms)).astype(np.int64), room[many].astype(np.int32), place.astype(np.int32), customers[many], words)
    yield "seats", bucket, -1, state, 0
    log_p = np.zeros(len(words))
    log_p[place] = share[many] * (-np.log(2) / 2048)
    t, tables = chained(state, np.where(known > 0, known - 1, np.bincount(room, customers > 0, len(rooms))).astype(np.int64), log_p, 0)
    w, n = np.unique(word[one], return_counts=True)
    singles = {b: [(w[i:j] - starts[b]).astype(np.int32), n[i:j].astype(np.int32)] for b, i, j in by_bucket(w, starts)}
    yield from sent_up(bucket, state, t, tables, starts, singles)
    yield "tables", bucket, -1, packed(tables, customers[many], t if kept else 0 * t, *[tables][: int(kept)]), 0


def parent_of(rows: list[tuple[str, int, bytes]], size: int, start: int, sweep: int, rate: float, kept: bool) -> tuple[bytes, int]:
    """Seats one bucket of words in the parent: its state, and its tables. `rows`: (kind, context bucket, payload), the contexts' tables and the state before.

    The state is customers that never change, context buckets, how many words each has here and their places; the customers and
    tables of this sweep; and each kept sweep's customers less d for each table.
    """
    ups = [(k, unpacked(p)) for kind, k, p in sorted(r for r in rows if r[0] == "up")]
    before = [unpacked(p) for kind, _, p in rows if kind == "parent"]
    if before:
        base, buckets, lengths, places, _, _, *values = before[0]
    else:
        base, values = np.zeros(size, np.int64), []
        for _, (_, _, w, n) in ups:
            base[w] += n
        buckets, lengths = np.array([k for k, _ in ups], np.int64), np.array([len(x[1]) for _, x in ups], np.int64)
        places = np.concatenate([x[1] for _, x in ups])
    c = base + np.bincount(places, np.concatenate([np.zeros(0), *(x[0] for _, x in ups)]), size).astype(np.int64)
    t = drawn(c, np.full(size, rate), keys(start + np.arange(size), 0, sweep, 3))
    values = [*values, *[(c - DISCOUNT * t).astype(np.float32)][: int(kept)]]
    return packed(base, buckets, lengths, places, c, t, *values), int(t.sum())


def weights_of(state: bytes, start: int, sweep: int, mass: float) -> tuple[list[tuple[int, bytes]], float]:
    """What each word of a bucket weighs in the parent, drawn given its customers and tables: for each context bucket, and the sum."""
    _, buckets, lengths, places, c, t, *_ = unpacked(state)
    seen = np.flatnonzero(c)
    number = start + seen
    weight = np.zeros(len(c), np.float32)
    weight[seen] = gammas(c[seen] - DISCOUNT * t[seen], keys(number, 0, sweep, 4)) + tempered(mass, keys(number, 0, sweep, 5))
    return [(k, own.tobytes()) for k, own in zip(buckets.tolist(), np.split(weight[places], np.cumsum(lengths)[:-1]), strict=True) if len(own)], float(weight.sum(dtype=np.float64))


class Parent:
    """Of the chain's parent what no single word decides, drawn in turn: `mass` of an atom of the base, `rate` of its tables, `total` of the weights.

    Weights are jumps of a stable process with exp(-x), run for a gamma time; a gamma variable with as many degrees as the parent has
    customers stands for the power of the jumps' sum, and given it words are independent. One more than it is `exp(log_scale)`.
    """

    def __init__(self, n_words: int) -> None:
        self.n_words, self.mass, self.log_scale, self.total = n_words, 1.0, 0.0, 0.0

    def one(self, shape: float, sweep: int, use: int) -> float:
        return float(gammas(np.array([shape]), keys(np.array([0]), 1, sweep, use))[0])

    def rate(self, customers: int, sweep: int) -> float:
        """Log of what a table of the parent weighs, once its customers are counted."""
        if self.total and customers:
            before, self.log_scale = self.log_scale, float(np.log1p(self.one(customers, sweep, 6) / self.total))
            self.mass *= float(np.exp(DISCOUNT * (self.log_scale - before)))
        return float(np.log(DISCOUNT * self.mass))

    def seat(self, tables: int, sweep: int) -> None:
        """Draws the time again, once the parent's tables are counted."""
        time = self.one(STRENGTH / DISCOUNT + tables, sweep, 7)
        self.mass = time / (self.n_words + 1)
        if not self.total:
            self.log_scale = max(float(np.log(time * DISCOUNT / STRENGTH)) / DISCOUNT, 0.0)

    def weigh(self, weights: float, sweep: int) -> float:
        """Sum of all weights: those of the words and that of the unknown one."""
        every = float(np.float32(weights + tempered(self.mass, keys(np.array([self.n_words]), 2, sweep, 8))[0]))  # the order of a sum shall not show
        self.total = every / float(np.exp(self.log_scale))
        return every


def context_bucket(rows: list[tuple[int, bytes]], bucket: int, starts: np.ndarray) -> Iterator[tuple[str, int, int, bytes]]:
    """Restaurants of one bucket: ("bigrams", chunk, bucket, customers' and contexts' weights), ("words", word bucket, -, tables)
    and ("rooms", -, -, split contexts and their tables here). `starts`: first word number of each word bucket."""
    dish, sizes, heads, u, word, share, known, customers = merged(rows)
    _, of_room, room = np.unique(u, return_index=True, return_inverse=True)
    parent = 2.0 ** (-share.astype(float) / 2048)
    with np.errstate(over="ignore"):
        key = mixed(mixed(u.astype(U64) + U64(1)) * GOLD + word.astype(U64))
    spread = known[of_room] > 0
    dishes = np.where(spread, known[of_room] - 1, np.bincount(room, customers > 0)).astype(np.int64)
    # Every dish starts at one table; these are the others' tables in all sweeps.
    total = seated(customers, np.maximum(dishes[room] - 1, 0), parent, key)
    weight = customers - DISCOUNT * total / SWEEPS
    tables = np.bincount(room, total).astype(np.int64)
    if spread.any():  # of a split context this is one part; the parts are added up before they are used
        yield "rooms", -1, -1, u[of_room[spread]].tobytes() + tables[spread].tobytes()
    context = (DISCOUNT * tables / SWEEPS).astype(np.float32)  # strength is added once, by the chunk
    code = np.where(customers > 1, 255, customers)
    a = 0
    for (chunk, _), size, head in zip(rows, sizes, heads, strict=True):
        own = dish[a : a + size]
        a += size
        split = u[own[head]][known[own[head]] > 0]  # the chunk looks these contexts' sums up by number
        yield "bigrams", chunk, bucket, context[room[own[head]]].tobytes() + few_bytes(code[own], weight[own]) + split.tobytes()
    w, at = np.unique(word, return_inverse=True)
    t = np.bincount(at, total).astype(np.int64)
    w, t = w[t > 0], t[t > 0]
    there = np.searchsorted(starts, w, "right") - 1
    values, start = np.unique(there, return_index=True)
    for b, i, j in zip(values.tolist(), start, [*start[1:], len(w)], strict=True):
        yield "words", b, -1, np.array([j - i], np.uint32).tobytes() + planes(w[i:j] - starts[b], 5) + planes(t[i:j], 5)


def word_bucket(counts: list[tuple[int, bytes]], tables: list[bytes], n_words: int) -> tuple[list[tuple[int, bytes]], int, tuple]:
    """One bucket of words: of each chunk, its words' places in the bucket and counts or, once `tables` are known, customers' weights
    in the shared parent; the bucket's number of words; and its sums."""
    hashes = [np.frombuffer(data, U64, len(data) // 12) for _, data in counts]
    words, of = np.unique(np.concatenate(hashes), return_inverse=True)
    c = np.bincount(of, np.concatenate([np.frombuffer(data, np.uint32, -1, 8 * len(h)) for (_, data), h in zip(counts, hashes, strict=True)])).astype(np.int64)
    t = np.zeros(len(words), np.int64)
    for data in tables:
        n = int(np.frombuffer(data, np.uint32, 1)[0])
        t[numbers(data, n, 5, 4)] += numbers(data, n, 5, 4 + 5 * n)
    customers = np.where(c > 0, np.maximum(1, np.rint(t / SWEEPS)), 0).astype(np.int64)
    own = np.zeros(len(words))
    if n_words:  # every word starts at one table of the parent, whose own parent deals n_words + 1 equal shares
        own = seated(customers, np.full(len(words), n_words - 1), np.full(len(words), 1 / (n_words + 1)), mixed(words + U64(77))) / SWEEPS
    value = (customers - DISCOUNT * own).astype(np.float32)
    out, a = [], 0
    for (chunk, _), h in zip(counts, hashes, strict=True):
        mine = of[a : a + len(h)]
        a += len(h)
        out.append((chunk, planes(c[mine], 6) + (value[mine].tobytes() if n_words else planes(mine, 4))))
    return out, len(words), (int(c.sum()), int((c > 0).sum()), float(customers.sum()), float((DISCOUNT * own).sum()))


SENT = "kind string, bucket long, chunk long, payload binary, n long, v long, customers double, spread double"
_SENT = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("payload", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("customers", pa.float64()), ("spread", pa.float64())])


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)] if rows else [pa.array([], f.type) for f in _SENT], schema=_SENT)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_of: int = 10, burn: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text.

    Learns from all texts but those whose crc32(doc_id as text) mod `held_of` is 0, and scores all. A text
    is its words and one end; `score` is the sum of log10 P(word | word before), with
    P(w | u) = (c - d t + (strength + d T) P(w)) / (strength + C) in the restaurant of u, and P(w) alike
    in the parent's, over equal shares for all known words and an unknown one.

    With `burn` SWEEPS sweeps of the Gibbs chain follow `burn` others, and P(w | u) is the mean of their predictive
    probabilities. Without it no chain is run: t and T are means over SWEEPS first seatings, where P(w) is the
    word's share of the corpus, and each dish sees the other dishes at one table each.

    Frequent contexts are split over buckets by word; sums over the parts are gathered where the whole
    context counts. Equal tables give equal scores however they are partitioned. Null texts are empty and
    have one token, the end; null ids are learned from. Equal rows count each; other columns are ignored;
    an empty table gives no row.
    """
    spark = docs.sparkSession
    text = text_of(docs, text_col)
    doc = F.col(id_col).cast("long").alias("doc_id")
    held = (F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(held_of)) == 0).alias("held")
    made = bucketed(chunks(docs.select(doc, text.alias("text"), held), "held"), "chunks", "chunk")
    total = made.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(-(-total // BUCKET_TOKENS)), 1)

    # Contexts with more than a quarter of a bucket: at most 4 * buckets of them.
    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = np.bincount(tokens_of(row))
                top = np.flatnonzero(n > n.sum() / (8 * buckets))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["vocabulary"], U64)[top].view(np.int64)), pa.array(n[top].astype(np.int64))], names=["h", "n"])

    share = max(1.0, total / (4 * buckets))
    top = made.select("tokens", "vocabulary").mapInArrow(frequent, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > share)
    hot = {r.h & (1 << 64) - 1: min(buckets, int(r.n // share) + 1) for r in top.collect()}

    def hot_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.array([*hot, 0], U64)[:-1]
        for batch in batches:
            for row in batch.to_pylist():
                hashes, tokens = np.frombuffer(row["vocabulary"], U64), tokens_of(row).astype(np.int64)
                train = np.repeat(np.array(row["train"], bool), np.frombuffer(row["lengths"], np.int32))
                before = np.concatenate([[0], tokens[:-1]])
                fine = train & np.isin(hashes, keys)[before]
                pair = np.unique(before[fine] * len(hashes) + tokens[fine])
                first, w = pair // len(hashes), hashes[pair % len(hashes)]
                part = (((w >> U64(32)) * np.array([hot[int(h)] for h in hashes[np.unique(first)]], U64)[np.unique(first, return_inverse=True)[1]]) >> U64(32)).astype(np.int64)
                order = np.lexsort((w, part, first))
                both = first[order] << 32 | part[order]
                values, at = np.unique(both, return_index=True)
                rows = [[int(hashes[x >> 32].view(np.int64)), x & (1 << 32) - 1, w[order[i:j]].tobytes()] for x, i, j in zip(values.tolist(), at, np.append(at, len(order))[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["u", "part", "words"])

    def distinct(key: tuple, group: pa.Table) -> pa.Table:
        words = np.frombuffer(b"".join(group.column("words").to_pylist()), U64)
        return pa.table({"u": [key[0].as_py()], "n": [len(np.unique(words))]})

    # Dishes of each split context, over all its parts, which are ranges of words here.
    types = {}
    if hot:
        parts = made.mapInArrow(hot_pairs, "u long, part long, words binary").groupBy("u", "part").applyInArrow(distinct, "u long, n long")
        types = {r.u & (1 << 64) - 1: r.n for r in parts.groupBy("u").agg(F.sum("n").alias("n")).collect()}

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, tokens = np.frombuffer(row["vocabulary"], U64), tokens_of(row)
                train = np.repeat(np.array(row["train"], bool), np.frombuffer(row["lengths"], np.int32))
                n = np.bincount(tokens[train], minlength=len(hashes)).astype(np.uint32)
                order, place = by_place(hashes, buckets)
                values, first = np.unique(place, return_index=True)
                parts = [(b, order[i:j]) for b, i, j in zip(values.tolist(), first, [*first[1:], len(order)], strict=True)]
                yield from _rows([("counts", b, row["chunk"], hashes[o].tobytes() + n[o].tobytes(), 0, 0, 0.0, 0.0) for b, o in parts]).to_batches()

    def seat_words(n_words: int) -> Callable[[pa.Table], pa.Table]:
        def run(group: pa.Table) -> pa.Table:
            bucket = group.column("bucket")[0].as_py()
            rows = list(zip(group.column("kind").to_pylist(), group.column("chunk").to_pylist(), group.column("payload").to_pylist(), strict=True))
            counts = sorted((c, p) for k, c, p in rows if k == "counts")
            if not counts:
                return _rows([])
            out, size, sums = word_bucket(counts, [p for k, _, p in rows if k == "words"], n_words)
            return _rows([("counts", bucket, c, data, 0, 0, 0.0, 0.0) for c, data in out] + [("sums", bucket, size, b"", *sums)])

        return run

    def sums_of(words: DataFrame) -> tuple:
        return tuple(x or 0 for x in words.where("kind = 'sums'").agg(F.sum("n"), F.sum("v"), F.sum("customers"), F.sum("spread")).first())

    asked = made.mapInArrow(send_words, SENT)
    counted = written(asked.groupBy("bucket").applyInArrow(seat_words(0), SENT), "counts", free=True)
    n_train, n_words, *_ = sums_of(counted)
    # First word number of each bucket; words are numbered in the order of their hashes.
    starts = np.zeros(buckets + 1, np.int64)
    for r in counted.where("kind = 'sums'").select("bucket", "chunk").collect():
        starts[r.bucket + 1] = r.chunk
    sizes = starts[1:].tolist()
    starts = np.cumsum(starts)[:-1]

    # Predictions that a chunk averages: of each kept sweep of the chain, or one of mean tables.
    means = 1 if burn is None else SWEEPS

    def word_info(c: Chunk, table: pa.Table, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of each word of a chunk: its count, and its weight in the parent (`last`) or its number."""
        count, value = np.zeros(len(c.hashes), np.int64), np.zeros((means, len(c.hashes))) if last else np.zeros(len(c.hashes), np.int64)
        got = {b: p for k, b, p in zip(*(table.column(x).to_pylist() for x in ("kind", "bucket", "payload")), strict=True) if k == "counts"}
        for b, i, j in c.bounds(c.word_bucket):
            own = c.word_order[i:j]
            count[own] = numbers(got[b], j - i, 6, 0)
            if last and burn is not None:
                value[:, own] = [returned(x, np.float32) for x in np.split(np.frombuffer(got[b], np.uint8, -1, 6 * (j - i)), means)]
                continue
            value[..., own] = np.frombuffer(got[b], np.float32, j - i, 6 * (j - i)) if last else starts[b] + numbers(got[b], j - i, 4, 6 * (j - i))
        return count, value

    def send(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        if not rows:
            return _rows([])
        c = Chunk(rows[0], buckets, hot)
        count, number = word_info(c, right, False)
        share = (count + 0.1) / (n_train + 0.1 * (n_words + 1))
        return _rows([("bigrams", b, rows[0]["chunk"], data, 0, 0, 0.0, 0.0) for b, data in c.sent(number, share, types)])

    def seat(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("chunk").to_pylist(), group.column("payload").to_pylist(), strict=True))
        bucket = group.column("bucket")[0].as_py()
        out = []
        for kind, a, b, data in context_bucket(rows, bucket, starts):
            out.append((kind, b, a, data, 0, 0, 0.0, 0.0) if kind != "words" else (kind, a, -1, data, 0, 0, 0.0, 0.0))
        return _rows(out)

    def summed(df: DataFrame) -> dict[int, int]:
        """What all tables of each split context weigh, by its number: at most 8 * buckets parts."""
        whole: dict[int, int] = {}
        for r in df.where("kind = 'rooms'").select("payload").collect():
            n = len(r.payload) // 16
            for u, x in zip(*np.frombuffer(r.payload, np.int64).reshape(2, n).tolist(), strict=True):
                whole[u] = whole.get(u, 0) + x
        return whole

    def parts_of(group: pa.Table) -> tuple[int, list[tuple[str, int, bytes]]]:
        return group.column("bucket")[0].as_py(), list(zip(group.column("kind").to_pylist(), group.column("chunk").to_pylist(), (x.as_buffer() for x in group.column("payload")), strict=True))

    def rows_of(found: Iterator[tuple[str, int, int, bytes, int]]) -> pa.Table:
        return _rows([(*x, 0, 0.0, 0.0) for x in found])

    def first_sweep(group: pa.Table) -> pa.Table:
        bucket, rows = parts_of(group)
        return rows_of(restaurants(sorted((k, p) for _, k, p in rows), bucket, starts, burn == 0))

    def parents(sweep: int, rate: float, kept: bool) -> Callable[[pa.Table], pa.Table]:
        def run(group: pa.Table) -> pa.Table:
            bucket, rows = parts_of(group)
            state, n = parent_of(rows, sizes[bucket], int(starts[bucket]), sweep, rate, kept)
            return rows_of([("parent", bucket, -1, state, 0), ("sums", bucket, -1, b"", n)])

        return run

    def weigh(sweep: int, mass: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    out, total = weights_of(row["payload"], int(starts[row["bucket"]]), sweep, mass)
                    yield from _rows([("down", k, row["bucket"], data, 0, 0, 0.0, 0.0) for k, data in out] + [("sums", row["bucket"], -1, b"", 0, 0, total, 0.0)]).to_batches()

        return run

    def children(sweep: int, total: float, whole: dict[int, int], kept: bool, last: bool) -> Callable[[pa.Table], pa.Table]:
        def run(group: pa.Table) -> pa.Table:
            bucket, rows = parts_of(group)
            state, old = (next((p for kind, _, p in rows if kind == x), None) for x in ("seats", "tables"))
            if state is None:
                return _rows([])
            tables, customers, sums, *values = unpacked(old)
            rooms, split, *_ = unpacked(state)
            if split.any():
                tables = tables.copy()
                tables[split] = [whole[u] for u in rooms[split].tolist()]
            weight = np.frombuffer(b"".join(p for _, _, p in sorted(r for r in rows if r[0] == "down")), np.float32)
            t, tables = chained(state, tables, np.log(weight / total), sweep)
            sums, values = sums + t * kept, [*values, *[tables][: int(kept)]]
            if last:  # what the chunks are answered from, and nothing else
                weight = (customers - DISCOUNT * sums / SWEEPS).astype(np.float32)
                carried = packed(rooms[split], split, turned(weight), *(planes(x, 5) for x in values))
            else:
                carried = packed(tables, customers, sums, *values)
            return rows_of([*sent_up(bucket, state, t, tables, starts), ("told" if last else "tables", bucket, -1, carried, 0)])

        return run

    def run_chain(sent: DataFrame) -> tuple[DataFrame, DataFrame, dict[int, list[int]], list[int], list[int]]:
        """Answers to the chunks, the parent's state, and of each kept sweep: tables of split contexts, customers and tables of the parent."""
        base = written(sent.groupBy("bucket").applyInArrow(first_sweep, SENT), "restaurants", free=True)
        tables, parent, wholes, customers, spread = base, None, [], [], []
        state = Parent(n_words)
        for sweep in range(burn + SWEEPS):
            last, kept = sweep + 1 == burn + SWEEPS, sweep >= burn
            whole, n = summed(tables), tables.where("kind = 'sums'").agg(F.sum("n")).first()[0] or 0
            ups = tables.where("kind = 'up'")
            if parent is not None:
                ups = ups.unionByName(parent.where("kind = 'parent'"))
            old, parent = parent, written(ups.groupBy("bucket").applyInArrow(parents(sweep, state.rate(n, sweep), kept), SENT), "parent", free=True)
            n_tables = parent.where("kind = 'sums'").agg(F.sum("n")).first()[0] or 0
            if old is not None:
                dropped(old)
            if kept:
                wholes.append(whole)
                customers.append(n)
                spread.append(n_tables)
            if last:
                break
            state.seat(n_tables, sweep)
            down = written(parent.where("kind = 'parent'").mapInArrow(weigh(sweep, state.mass), SENT), "weights")
            every = state.weigh(down.agg(F.sum("customers")).first()[0] or 0.0, sweep)
            moved = base.where("kind = 'seats'").unionByName(down.where("kind = 'down'")).unionByName(tables.where("kind = 'tables'"))
            old, tables = tables, written(moved.groupBy("bucket").applyInArrow(children(sweep + 1, every, whole, sweep + 1 >= burn, sweep + 2 == burn + SWEEPS), SENT), "tables", free=True)
            dropped(down)
            if old is not base:
                dropped(old)
        asks = written(base.where("kind = 'asks'"), "asks")
        dropped(base)
        back = asks.unionByName(tables.where("kind = 'told'")).groupBy("bucket").applyInArrow(answers, SENT)
        return back, parent, {u: [w[u] for w in wholes] for u in whole}, customers, spread

    def answers(group: pa.Table) -> pa.Table:
        bucket, rows = parts_of(group)
        told = next((p for kind, _, p in rows if kind == "told"), None)
        if told is None:
            return _rows([])
        split_rooms, split, weight, *values = unpacked(told)
        weight, values = returned(weight, np.float32), [numbers(x, len(split), 5, 0) for x in values]
        rooms = np.zeros(len(split), np.int64)
        rooms[split] = split_rooms
        out = []
        for kind, chunk, payload in rows:
            if kind == "asks":
                code, *steps_of = unpacked(payload)
                many, room = map(summed_up, steps_of)
                contexts = [planes(x[room], 5) for x in values]
                out.append(("bigrams", bucket, chunk, packed(code, turned(weight[many]), rooms[room][split[room]], *contexts), 0))
        return rows_of(out)

    def last_words(group: pa.Table) -> pa.Table:
        """Of each chunk's words: counts, and what their customers weigh in the parent in each kept sweep."""
        bucket, rows = parts_of(group)
        state = next((unpacked(p)[6:] for kind, _, p in rows if kind == "parent"), None)
        values = np.stack(state) if state else np.zeros((SWEEPS, sizes[bucket]), np.float32)
        out = []
        for kind, chunk, p in rows:
            if kind == "counts":
                n = len(p) // 10
                out.append(("counts", bucket, chunk, bytes(p[: 6 * n]) + b"".join(turned(x) for x in values[:, numbers(p, n, 4, 6 * n)]), 0))
        return rows_of(out)

    sent = made.groupBy("chunk").cogroup(counted.where("kind = 'counts'").groupBy("chunk")).applyInArrow(send, SENT)
    if burn is None:
        back = written(sent.groupBy("bucket").applyInArrow(seat, SENT), "bigrams")
        whole = {u: [x / SWEEPS] for u, x in summed(back).items()}
        words = written(asked.unionByName(back.where("kind = 'words'")).groupBy("bucket").applyInArrow(seat_words(n_words), SENT), "words")
        customers, spread = ([x] for x in sums_of(words)[2:])
        dropped(counted)
    else:
        back, parent, whole, customers, tables = run_chain(sent)
        words = counted.where("kind = 'counts'").unionByName(parent.where("kind = 'parent'")).groupBy("bucket").applyInArrow(last_words, SENT)
        spread = [DISCOUNT * x for x in tables]

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        if not rows:
            return scores_of([])
        c = Chunk(rows[0], buckets, hot)
        weight, rooms = np.zeros(len(c.u), np.float64), np.zeros((means, len(c.hashes)))
        got = {b: p for k, b, p in zip(*(right.column(x).to_pylist() for x in ("kind", "bucket", "payload")), strict=True) if k == "bigrams"}
        for b, i, j in c.bounds(c.bucket):
            u = c.u[i:j][np.sort(np.unique(c.u[i:j], return_index=True)[1])]
            if burn is None:
                rooms[:, u] = np.frombuffer(got[b], np.float32, len(u))
                code = np.frombuffer(got[b], np.uint8, j - i, 4 * len(u))
                at = 4 * len(u) + j - i
                of_many = np.frombuffer(got[b], np.float32, int((code == 255).sum()), at)
                split_rooms = np.frombuffer(got[b], np.int64, -1, at + 4 * len(of_many))
            else:
                code, of_many, split_rooms, *contexts = unpacked(got[b])
                of_many = returned(of_many, np.float32)
                rooms[:, u] = [(DISCOUNT * numbers(x, len(u), 5, 0)).astype(np.float32) for x in contexts]
            weight[i:j] = (1 - DISCOUNT) * (code == 1)
            weight[i:j][code == 255] = of_many
            # Of a split context this chunk may have met some parts only.
            split = u[c.split[u] > 1]
            for k, x in zip(split.tolist(), split_rooms.tolist(), strict=True):
                rooms[:, k] = np.float32(DISCOUNT * np.array(whole[x]))
        count, value = word_info(c, right, True)
        parent = 0
        for room, of_word, n, x in zip(rooms, value, customers, spread, strict=True):
            p = (of_word + (STRENGTH + x) / (n_words + 1)) / (STRENGTH + n)
            parent = parent + (STRENGTH + room[c.u]) * p[c.w] / means
        log_pair = np.empty(len(c.u))
        log_pair[c.order] = np.log10((weight + parent) / (STRENGTH + count[c.u]))
        log_base = np.log10((count + 0.1) / (n_train + 0.1 * (n_words + 1)))
        ends = np.cumsum(c.lengths)
        starts = ends - c.lengths
        add = lambda x: np.add.reduceat(x, starts)  # noqa: E731  no text is without a token
        row = rows[0]
        return scores_of(list(zip(row["doc_ids"], [not t for t in row["train"]], c.lengths.tolist(), add((count > 0)[c.tokens].astype(np.int64)).tolist(), [n_train] * len(ends), add(log_base[c.tokens]).tolist(), add(log_pair[c.of]).tolist(), strict=True)))

    need = back.where("kind = 'bigrams'").unionByName(words.where("kind = 'counts'"))
    return made.groupBy("chunk").cogroup(need.groupBy("chunk")).applyInArrow(finish, SCORES)


def scores_of(rows: list[tuple]) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
