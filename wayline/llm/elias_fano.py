"""Elias-Fano sequences: monotone numbers in about 2 + log2(universe / n) bits each, searched without decoding."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BLOCK = 8  # words of the upper bits per entry of the directory


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit (from 0) of each word, by halving."""
    at = np.zeros(len(word), np.int64)
    k = k.copy()
    for width in (32, 16, 8, 4, 2, 1):
        low = (word >> at.astype(U64)) & U64((1 << width) - 1)
        n = np.bitwise_count(low).astype(np.int64)
        up = k >= n
        k -= np.where(up, n, 0)
        at += np.where(up, width, 0)
    return at


class EliasFano:
    """A non-decreasing sequence; all methods take and give arrays."""

    NAMES = ("meta", "low", "high", "ones")

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.bits, self.universe = (int(x) for x in parts["meta"])
        self.low, self.high, self.ones = parts["low"], parts["high"], parts["ones"]

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        """values: sorted, each below universe."""
        values = values.astype(U64)
        n = len(values)
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        low = np.zeros((n * bits + 63) // 64 + 1, U64)
        if bits:
            x, at = values & U64((1 << bits) - 1), np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(U64)
            np.bitwise_or.at(low, word, x << shift)
            over = (at & 63) + bits > 64
            np.bitwise_or.at(low, word[over] + 1, x[over] >> (U64(64) - shift[over]))
        place = (values >> U64(bits)).astype(np.int64) + np.arange(n)
        words = -(-(n + (universe >> bits) + 2) // 64)
        words = -(-words // BLOCK) * BLOCK
        high = np.zeros(words, U64)
        np.bitwise_or.at(high, place >> 6, U64(1) << (place & 63).astype(U64))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64))])
        return cls({"meta": np.array([n, bits, universe], np.int64), "low": low, "high": high, "ones": ones})

    def parts(self) -> dict[str, np.ndarray]:
        return {"meta": np.array([self.n, self.bits, self.universe], np.int64), "low": self.low, "high": self.high, "ones": self.ones}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(U64)
        x = self.low[word] >> shift
        over = (at & 63) + self.bits > 64
        x[over] |= self.low[word[over] + 1] << (U64(64) - shift[over])
        return x & U64((1 << self.bits) - 1)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th one or zero in the upper bits."""
        count = self.ones if one else np.arange(len(self.ones), dtype=np.int64) * (64 * BLOCK) - self.ones
        block = np.searchsorted(count, k, side="right") - 1
        k = k - count[block]
        word = block * BLOCK
        for _ in range(BLOCK - 1):
            x = self.high[word]
            n = np.bitwise_count(x if one else ~x).astype(np.int64)
            on = k >= n
            k = k - np.where(on, n, 0)
            word = word + on
            if not on.any():
                break
        x = self.high[word]
        return word * 64 + _select_in_word(x if one else ~x, k)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers."""
        i = np.asarray(i, np.int64)
        return (((self._select(i, True) - i).astype(U64) << U64(self.bits)) | self._low(i)).astype(np.int64)

    def _run(self, place: np.ndarray) -> np.ndarray:
        """How many ones follow from a place of the upper bits on, up to 64."""
        word, shift = place >> 6, (place & 63).astype(U64)
        x = self.high[word] >> shift
        over = np.flatnonzero(shift > 0)
        following = self.high[np.minimum(word[over] + 1, len(self.high) - 1)]
        x[over] |= following << (U64(64) - shift[over])
        return np.bitwise_count(x & ~(x + U64(1))).astype(np.int64)  # the lowest ones

    def locate(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first number not below x (n if there is none), and whether it is x: the successor search."""
        x = np.asarray(x).astype(U64)
        out, exact = np.full(len(x), self.n, np.int64), np.zeros(len(x), bool)
        inside = np.flatnonzero(x < U64(self.universe))
        x = x[inside]
        if not len(x) or not self.n:
            return out, exact
        bucket = (x >> U64(self.bits)).astype(np.int64)
        # A bucket's ones stand between two zeros of the upper bits.
        begin = np.where(bucket > 0, self._select(np.maximum(bucket - 1, 0), False) + 1, 0)
        lo = begin - bucket
        n = self._run(begin)
        hi = lo + n
        if (many := np.flatnonzero(n == 64)).size:
            hi[many] = self._select(bucket[many], False) - bucket[many]
        end = hi.copy()
        want = x & U64((1 << self.bits) - 1) if self.bits else np.zeros(len(x), U64)
        while (open_ := np.flatnonzero(lo < hi)).size:  # halving within the bucket, over the low bits alone
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        out[inside] = lo
        there = np.flatnonzero(lo < end)
        exact[inside[there]] = self._low(lo[there]) == want[there]
        return out, exact

    def find(self, x: np.ndarray) -> np.ndarray:
        return self.locate(x)[0]

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.low, self.high, self.ones))
