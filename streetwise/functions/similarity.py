"""Text similarity: Jaro-Winkler in both variants, and bigram Jaccard.

Spark has no Jaro-Winkler. The Arrow UDF compares a whole batch at once: strings
become matrices of code points, and each step of the matching is one array
operation over all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.zeros((len(texts), max(int(size.max(initial=0)), 1)), dtype=np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out, size


def jaro_winkler_many(a: list[str], b: list[str], boost: float | None = 0.7) -> np.ndarray:
    """Similarities of pairs. ``boost`` is what Jaro must exceed for the prefix bonus;
    None gives the bonus always and counts transpositions in halves."""
    if not a:
        return np.zeros(0)
    (x, n), (y, m) = _codes(a), _codes(b)
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    j = np.arange(y.shape[1])
    free = j < m[:, None]
    hit = np.zeros(x.shape, dtype=bool)
    for i in range(x.shape[1]):
        can = free & (y == x[:, i, None]) & (j >= (i - reach)[:, None]) & (j <= (i + reach)[:, None])
        rows = np.flatnonzero(can.any(axis=1) & (i < n))
        hit[rows, i] = True
        free[rows, can[rows].argmax(axis=1)] = False
    used = (j < m[:, None]) & ~free
    common = hit.sum(axis=1)
    front = lambda codes, mask: np.take_along_axis(codes, np.argsort(~mask, axis=1, kind="stable"), axis=1)
    width = min(x.shape[1], y.shape[1])
    p, q = front(x, hit)[:, :width], front(y, used)[:, :width]
    swaps = ((p != q) & (np.arange(width) < common[:, None])).sum(axis=1)
    swaps = swaps / 2 if boost is None else swaps // 2
    k = min(4, width)
    same = (x[:, :k] == y[:, :k]) & (np.arange(k) < np.minimum(n, m)[:, None])
    return _from_counts(common, swaps, n, m, np.cumprod(same, axis=1).sum(axis=1), boost)


def _from_counts(common: np.ndarray, swaps: np.ndarray, n: np.ndarray, m: np.ndarray, prefix: np.ndarray, boost: float | None) -> np.ndarray:
    c = common.astype(float)
    jaro = np.where(common > 0, (c / np.maximum(n, 1) + c / np.maximum(m, 1) + (c - swaps) / np.maximum(c, 1)) / 3.0, 0.0)
    bonus = (common > 0) & ((jaro > boost) if boost is not None else True)
    # One rounding, as with a fused multiply-add.
    wide = jaro.astype(np.longdouble) + (prefix * 0.1).astype(np.longdouble) * (1.0 - jaro).astype(np.longdouble)
    return np.where(bonus, wide.astype(float), jaro)


class Names:
    """Different names, of which pairs are compared by their places in the list.

    A name's places of each letter are the bits of one number, so a step of the matching
    is a few operations on a number a pair. Pairs with a name of over 64 characters, or of
    names with very many letters, take the plain way."""

    #: Pairs compared at once: their numbers stay in the processor's cache.
    CHUNK = 16_384
    #: Numbers in the table of places, at most.
    PLACES = 1 << 22

    def __init__(self, names: list[str]):
        self.names = names
        codes, self.size = _codes(names)
        self.short = self.size <= 64
        codes = codes[:, :64]
        letters, dense = np.unique(codes, return_inverse=True)
        live = np.arange(codes.shape[1]) < self.size[:, None]
        self.none = len(letters)
        self.letter = np.where(live, dense.reshape(codes.shape), self.none).T.copy()
        self.able = len(names) * (self.none + 1) <= self.PLACES
        if self.able:
            self.places = np.zeros((len(names), self.none + 1), dtype=np.uint64)
            for i, row in enumerate(self.letter):
                mine = np.flatnonzero(live[:, i])
                self.places[mine, row[mine]] |= np.uint64(1) << np.uint64(i)
            self.places = self.places.ravel()
        self._bound(codes, live)

    def _bound(self, codes: np.ndarray, live: np.ndarray) -> None:
        """A name's letters A to Z, the space and all others, four bits each as many times as it has them, and the rest
        in all; its first four characters, 16 bits each."""
        kind = np.where(codes == 32, 26, np.where((codes >= 65) & (codes <= 90), codes.astype(np.int64) - 65, 27))
        times = np.zeros((len(self.names), 28), dtype=np.int64)
        row, _ = np.nonzero(live)
        np.add.at(times, (row, kind[live]), 1)
        bits = np.array([0, 1, 3, 7, 15], dtype=np.uint64)[np.minimum(times, 4)]
        shift = np.uint64(4) * np.arange(14, dtype=np.uint64)
        self.low, self.high = (np.bitwise_or.reduce(bits[:, h] << shift, axis=1) for h in (slice(0, 14), slice(14, 28)))
        self.more = np.maximum(times - 4, 0).sum(axis=1) + np.maximum(self.size - 64, 0)
        self.first = np.zeros(len(self.names), dtype=np.uint64)
        for i in range(4):
            at = codes[:, i].astype(np.uint64) & np.uint64(0xFFFF) if i < codes.shape[1] else np.uint64(0)
            self.first = (self.first << np.uint64(16)) | at
        self.share = 1.0 / np.maximum(self.size, 1)

    def at_most(self, a: np.ndarray, b: np.ndarray, boost: float = 0.7, of: Runs | None = None) -> np.ndarray:
        """What the similarity of pairs can be at most, by the letters that they have in common; of a name and any name of a run."""
        y = self if of is None else of
        low, high = self.low[a], self.high[a]
        common = np.bitwise_count(low & y.low[b]).astype(np.int64) + np.bitwise_count(high & y.high[b])
        if of is not None:
            common = np.minimum(common, np.bitwise_count(low & of.core_low[b]).astype(np.int64) + np.bitwise_count(high & of.core_high[b]) + of.extra[b])
        common += np.minimum(self.more[a], y.more[b])
        unlike = self.first[a] ^ y.first[b]
        if of is None:
            jaro = (common * (self.share[a] + y.share[b]) + 1.0) / 3.0
        else:  # no name has more letters in common than it has
            jaro = (np.minimum(common * self.share[a], 1.0) + np.minimum(common * y.share[b], 1.0) + 1.0) / 3.0
            unlike &= of.agreed[b]
        prefix = np.full(len(a), 0.0)
        for k in (48, 32, 16, 0):
            prefix += np.where(unlike < np.uint64(1) << np.uint64(k), 0.1, 0.0)
        return np.minimum(np.where(jaro > boost - 1e-9, prefix + jaro * (1.0 - prefix), jaro) + 1e-9, 1.0)

    def alike(self, a: np.ndarray, b: np.ndarray, boost: float | None = 0.7) -> np.ndarray:
        """Similarities of pairs, the same as of jaro_winkler_many()."""
        out, short = np.empty(len(a)), self.short[a] & self.short[b] if self.able else np.zeros(len(a), dtype=bool)
        plain, quick = np.flatnonzero(~short), np.flatnonzero(short)
        for s in range(0, len(plain), self.CHUNK):
            at = plain[s : s + self.CHUNK]
            out[at] = jaro_winkler_many([self.names[i] for i in a[at]], [self.names[i] for i in b[at]], boost)
        for s in range(0, len(quick), self.CHUNK):
            at = quick[s : s + self.CHUNK]
            out[at] = self._quickly(a[at], b[at], boost)
        return out

    def _quickly(self, a: np.ndarray, b: np.ndarray, boost: float | None) -> np.ndarray:
        n, m = self.size[a], self.size[b]
        reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
        row, one, zero = b * (self.none + 1), np.uint64(1), np.uint64(0)
        used, hits = np.zeros(len(a), dtype=np.uint64), []
        for i in range(int(n.max(initial=0))):
            where = self.places[row + self.letter[i][a]]
            can = where & _WINDOW[i][reach] & ~used
            bit = can & (~can + one)
            used |= bit
            hits.append((where, bit != zero))
        left, unlike = used.copy(), np.zeros(len(a), dtype=np.int64)
        for where, hit in hits:
            next_ = left & (~left + one)
            unlike += hit & ((where & next_) == zero)
            left ^= np.where(hit, next_, zero)
        swaps = unlike / 2 if boost is None else unlike // 2
        prefix, same = np.zeros(len(a), dtype=np.int64), np.ones(len(a), dtype=bool)
        for i in range(min(4, len(self.letter))):
            same = same & (self.letter[i][a] == self.letter[i][b]) & (i < np.minimum(n, m))
            prefix += same
        return _from_counts(np.bitwise_count(used).astype(np.int64), swaps, n, m, prefix, boost)


class Runs:
    """Stretches of a list of names (by their places, -1 is none), each beginning where ``start`` says: what any name of
    one may have of letters, so that Names.at_most() bounds its likeness with all of them."""

    def __init__(self, names: Names, at: np.ndarray, start: np.ndarray):
        live = at >= 0
        of = lambda values, none: np.where(live, values[np.maximum(at, 0)], none) if len(names.names) else np.full(len(at), none)
        self.low, self.high = (np.bitwise_or.reduceat(of(v, np.uint64(0)), start) for v in (names.low, names.high))
        # Letters that all names of a run have, and how many others one has at most.
        every = ~np.uint64(0)
        self.core_low, self.core_high = (np.bitwise_and.reduceat(of(v, every), start) for v in (names.low, names.high))
        size = np.maximum.reduceat(of(np.bitwise_count(names.low).astype(np.int64) + np.bitwise_count(names.high), 0), start)
        self.extra = np.maximum(size - np.bitwise_count(self.core_low) - np.bitwise_count(self.core_high), 0)
        self.more, self.share = np.maximum.reduceat(of(names.more, 0), start), np.maximum.reduceat(of(names.share, 0.0), start)
        first = of(names.first, np.uint64(0))
        self.first = first[start]
        unlike = np.bitwise_or.reduceat(first ^ np.repeat(self.first, np.diff(start, append=len(at))), start)
        #: The places of first characters in which all names of a run agree.
        self.agreed = np.zeros(len(start), dtype=np.uint64)
        for shift in (48, 32, 16, 0):
            mask = np.uint64(0xFFFF << shift)
            self.agreed |= np.where(unlike & mask, np.uint64(0), mask)


#: By a place and a reach: the places that are so near, as bits.
_WINDOW = np.array([[sum(1 << j for j in range(max(i - r, 0), min(i + r, 63) + 1)) for r in range(64)] for i in range(64)], dtype=np.uint64)


def named(a: pa.Array, b: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different names of two columns, and each row's place among them, from 1; 0 is null."""
    both = pa.concat_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (a.cast(pa.large_string()), b.cast(pa.large_string()))]).dictionary_encode()
    at = both.indices.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False) + 1
    return both.dictionary.to_pylist(), at[: len(a)], at[len(a) :]


def jaro_winkler(a: str, b: str, boost: float | None = 0.7) -> float:
    return float(jaro_winkler_many([a], [b], boost)[0])


def _udf(boost: float | None):
    def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
        names, x, y = named(a, b)
        both = (x > 0) & (y > 0)
        # Pairs repeat a lot within a block: each different one is compared once.
        pairs, of = np.unique(x[both] * (len(names) + 1) + y[both], return_inverse=True)
        out = np.zeros(len(x))
        out[both] = Names(names).alike(pairs // (len(names) + 1) - 1, pairs % (len(names) + 1) - 1, boost)[of] if len(pairs) else 0.0
        return pa.array(out, pa.float64(), mask=~both)

    return similarity


def jw(a: Column, b: Column, boost: float | None = 0.7) -> Column:
    """Jaro-Winkler similarity; null if either is null, 0 for two empty strings."""
    # Marked so that a filter on the value stays above the one place where it is computed.
    return F.arrow_udf(_udf(boost), "double").asNondeterministic()(a, b)


def bigram_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of character pairs; null if either is null or
    neither has a pair."""
    of = lambda t: F.when(F.length(t) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2))))).when(t.isNotNull(), F.array().cast("array<string>"))
    # A text is made once, not once for each pair of its characters.
    grams = lambda t: F.transform(F.array(t), of)[0]
    x, y = grams(a), grams(b)
    return F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0))
