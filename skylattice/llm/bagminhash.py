"""Weighted minhash signatures of shingle bags by hierarchical Poisson processes over discretised weights."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

#: Words a shingle has, components of a signature, bands and rows of a band.
WORDS, BANDS, ROWS = 5, 20, 4
COMPONENTS = BANDS * ROWS
U64 = np.uint64
_GOLD = U64(0x9E3779B97F4A7C15)
REMEMBERED = 200_000
_young: dict[bytes, int] = {}
_old: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer of whole arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit hashes."""
    return ((x >> U64(12)).astype(np.float64) + 0.5) * 2.0**-52


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, which space and \\x09-\\x0D separate."""
    global _young, _old
    words = (text or "").encode("utf-8", "surrogatepass").split()
    found = list(map(_young.get, words))
    if None in found:
        for i, (w, h) in enumerate(zip(words, found, strict=True)):
            if h is None:
                h = _young.get(w) or _old.get(w)
                if h is None:
                    h = xxhash.xxh64_intdigest(w)
                found[i] = h
                if len(_young) >= REMEMBERED:
                    _old, _young = _young, {}
                if len(w) <= 64:
                    _young[w] = h
    return np.array(found, U64)


def shingles(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of all runs of WORDS words; a shorter text is one shingle, an empty text none."""
    n = len(words)
    if not n:
        return words
    k = min(WORDS, n)
    out = np.full(n - k + 1, U64(k))
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mixed(out * _GOLD + words[i : n - k + 1 + i])
    return out


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and how often each occurs."""
    return np.unique(shingles(word_hashes(text)), return_counts=True)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Multiset Jaccard of two bags; two empty bags are alike."""
    low = 0
    if len(a[0]) and len(b[0]):
        at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
        both = a[0][at] == b[0]
        low = np.minimum(a[1][at[both]], b[1][both]).sum()
    total = a[1].sum() + b[1].sum() - low
    return float(low / total) if total else 1.0


def links(bags: Sequence[tuple[np.ndarray, np.ndarray]], least: float, side: np.ndarray | None = None, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of bags with a multiset Jaccard of at least `least` that join two classes; every other pair is less alike or in one class.

    Bags of one `label` are a class from the start; where `side` is given only bags of two sides are compared.
    A bag of which fewer shingles occur in others than any overlap needs is compared with none.
    """
    n = len(bags)
    size = np.array([b[1].sum() for b in bags], np.int64)
    if n == 2:
        apart = (side is None or side[0] != side[1]) and (label is None or label[0] != label[1])
        return [(0, 1)] if apart and size.all() and likeness(*bags) >= least else []
    lengths = np.array([len(b[0]) for b in bags])
    owner = np.repeat(np.arange(n), lengths)
    token, count = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags])
    _, token, times = np.unique(token, return_inverse=True, return_counts=True)
    kinds = len(times)
    fine = times[token] > 1
    owner, token, count = owner[fine], token[fine], count[fine]
    ends = np.cumsum(np.bincount(owner, minlength=n))
    starts = np.concatenate([[0], ends[:-1]])
    shared = np.bincount(owner, count, n).astype(np.int64)
    klass = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1]
    share = least / (1 + least)
    order = np.argsort(-shared / np.maximum(size, 1), kind="stable")
    todo = np.ones(n, bool)
    mark = np.zeros(kinds, np.int64)
    out = []
    for i in order.tolist():
        todo[i] = False
        need = share * (size[i] + size) - 1e-6
        may = todo & (klass != klass[i]) & (np.minimum(shared, shared[i]) >= need)
        if side is not None:
            may &= side != side[i]
        j = np.flatnonzero(may & (ends > starts))
        if not len(j):
            continue
        mine = slice(starts[i], ends[i])
        mark[token[mine]] = count[mine]
        held = ends[j] - starts[j]
        first = np.concatenate([[0], np.cumsum(held)[:-1]])
        at = np.arange(held.sum()) + np.repeat(starts[j] - first, held)
        low = np.add.reduceat(np.minimum(count[at], mark[token[at]]), first)
        mark[token[mine]] = 0
        for k in j[low / (size[i] + size[j] - low) >= least].tolist():
            if klass[k] != klass[i]:
                klass[klass == klass[k]] = klass[i]
                out.append((i, k))
    return out


def signatures(bags: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """bags x COMPONENTS of 64-bit names of least points; two bags agree in a component with probability their weighted Jaccard.

    A shingle's weights are discretised at 1, 2, 4, ...: over each stratum between two levels lies a
    Poisson process of rate its length, fixed by shingle and stratum, whose points carry a time, a
    component and a place in the stratum. A bag sees the strata below its count, and of the one its
    count falls into those points whose place lies below: halving strata till the count is met is
    deciding that place bit by bit. Points are made in the order of time and only up to a horizon by
    which every component has a point; where one has none, the horizon is doubled. That takes about
    m log m points for a bag of any size.
    """
    m = COMPONENTS
    names = np.zeros((len(bags), m), U64)
    size = np.array([len(b[0]) for b in bags])
    full = np.flatnonzero(size)
    if not len(full):
        return names
    owner0 = np.repeat(full, size[full])
    item0 = np.concatenate([bags[i][0] for i in full])
    count0 = np.concatenate([bags[i][1] for i in full]).astype(np.float64)
    weight = np.array([b[1].sum() for b in bags], np.float64)
    # Strata: [0, 1), [1, 2), [2, 4), ... up to the count.
    parts = [(owner0, item0, np.zeros(len(item0)), np.ones(len(item0)), count0, np.zeros(len(item0), U64))]
    low, level = 1.0, 1
    while (more := count0 > low).any():
        k = int(more.sum())
        parts.append((owner0[more], item0[more], np.full(k, low), np.full(k, low), count0[more], np.full(k, level, U64)))
        low, level = low * 2, level + 1
    owner, item, start, rate, count, stratum = (np.concatenate(x) for x in zip(*parts, strict=True))
    with np.errstate(over="ignore"):
        seed = mixed(item + mixed(stratum + U64(1)) * _GOLD)
    horizon = np.zeros(len(bags))
    horizon[full] = (np.log(m) + 3.0) * m / weight[full]
    open_ = np.zeros(len(bags), bool)
    open_[full] = True
    while open_.any():
        best = np.full((len(bags), m), np.inf)
        mine = open_[owner]
        o, s, a, r, c = owner[mine], seed[mine], start[mine], rate[mine], count[mine]
        t = np.zeros(len(o))
        step = U64(0)
        while len(o):
            with np.errstate(over="ignore"):
                step += U64(1)
                h = mixed(s + step * _GOLD)
            t = t - np.log(uniform(h)) / r
            on = t < horizon[o]
            o, s, a, r, c, t, h = o[on], s[on], a[on], r[on], c[on], t[on], h[on]
            mark = mixed(h ^ U64(0x5851F42D4C957F2D))
            seen = a + r * uniform(mark) < c
            part = (mixed(mark + _GOLD) % U64(m)).astype(np.int64)
            oo, pp, tt, hh = o[seen], part[seen], t[seen], h[seen]
            # Least time first, so that the first of a cell stays; a cell keeps the lesser of old and new.
            order = np.argsort(-tt, kind="stable")
            oo, pp, tt, hh = oo[order], pp[order], tt[order], hh[order]
            better = tt < best[oo, pp]
            oo, pp, tt, hh = oo[better], pp[better], tt[better], hh[better]
            best[oo, pp] = tt
            names[oo, pp] = hh
        open_ &= np.isinf(best).any(axis=1)
        horizon[open_] *= 2
    return names


def band_keys(names: np.ndarray) -> np.ndarray:
    """bags x BANDS of 64-bit bucket names."""
    out = np.arange(BANDS, dtype=U64)[None, :] * U64(0x2545F4914F6CDD1D) + U64(7) + np.zeros((len(names), 1), U64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            out = mixed(out * _GOLD + names[:, k::ROWS][:, :BANDS])
    return out
