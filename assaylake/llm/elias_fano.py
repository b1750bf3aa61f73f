"""Elias-Fano sequences and an n-gram trie over them, for arrays of queries at once."""

from __future__ import annotations

import json
import os

import numpy as np

_U = np.uint64
SAMPLE = 64
#: Codes of quantised probabilities: 0 is absent, code k stands for 10 ** (-(k - 1) * STEP).
STEP, CODES = 0.04, 255


class EliasFano:
    """A sorted sequence of n numbers below a universe u in about n (2 + log2(u / n)) bits.

    The low bits of each number are packed; the high bits are a bitmap in which the i-th one stands at high + i.
    Sampled counts over the bitmap serve select queries; all methods take arrays.
    """

    ARRAYS = ("low", "high", "ones", "zeros", "one_hint", "zero_hint")

    def __init__(self, size: int, bits: int, **arrays: np.ndarray):
        self.size, self.bits = size, bits
        for name in self.ARRAYS:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(_U)
        n = len(values)
        bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, dtype=_U)
        if n and bits:
            part = values & _U((1 << bits) - 1)
            at = np.arange(n, dtype=_U) * _U(bits)
            word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + _U(bits) > _U(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (_U(64) - shift[over]))
        top = (values >> _U(bits)).astype(np.int64) + np.arange(n)
        length = n + (max(0, universe - 1) >> bits) + 2
        bitmap = np.zeros(-(-length // 64) * 64, dtype=np.uint8)
        bitmap[top] = 1
        high = np.packbits(bitmap, bitorder="little").view(_U)
        count = np.bitwise_count(high).astype(np.int64)
        ones = np.concatenate([[0], np.cumsum(count)])
        zeros = np.arange(len(ones)) * 64 - ones
        hint = lambda c: np.maximum(np.searchsorted(c, np.arange(0, c[-1] + SAMPLE, SAMPLE), side="right") - 1, 0).astype(np.int32)
        return cls(n, bits, low=low, high=high, ones=ones, zeros=zeros, one_hint=hint(ones), zero_hint=hint(zeros))

    def _select(self, k: np.ndarray, counts: np.ndarray, hints: np.ndarray, flip: bool) -> np.ndarray:
        """The place of the one (or zero) with k others before it."""
        word = hints[k // SAMPLE].astype(np.int64)
        late = np.flatnonzero(counts[word + 1] <= k)
        while len(late):
            word[late] += 1
            late = late[counts[word[late] + 1] <= k[late]]
        bits = ~self.high[word] if flip else self.high[word]
        left = (k - counts[word]).astype(np.int64)
        place = np.zeros(len(k), dtype=np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            inside = np.bitwise_count(bits & _U((1 << width) - 1)).astype(np.int64)
            past = left >= inside
            left -= inside * past
            place += width * past
            bits = np.where(past, bits >> _U(width), bits)
        return word * 64 + place

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), dtype=_U)
        at = i.astype(_U) * _U(self.bits)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        first = self.low[word] >> shift
        rest = np.where(shift > 0, self.low[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
        return (first | rest) & _U((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i."""
        i = np.asarray(i, dtype=np.int64)
        return ((self._select(i, self.ones, self.one_hint, False) - i).astype(_U) << _U(self.bits)) | self._low(i)

    def _bucket(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have high bits below ``high``."""
        out = np.zeros(len(high), dtype=np.int64)
        some = np.flatnonzero(high > 0)
        h = np.minimum(high[some], int(self.zeros[-1]))
        out[some] = self._select(h - 1, self.zeros, self.zero_hint, True) - (h - 1)
        return np.minimum(out, self.size)

    def successor(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first number >= x, between places lo and hi if given, and whether it equals x."""
        x = np.asarray(x, dtype=_U)
        high, want = (x >> _U(self.bits)).astype(np.int64), x & _U((1 << self.bits) - 1)
        start, end = self._bucket(high), self._bucket(high + 1)
        if lo is not None:
            start = np.maximum(start, lo)
        if hi is not None:
            end = np.maximum(np.minimum(end, hi), start)
        stop = end.copy()
        todo = np.flatnonzero(start < end)
        while len(todo):  # the low bits are sorted inside a bucket
            middle = (start[todo] + end[todo]) >> 1
            less = self._low(middle) < want[todo]
            start[todo] = np.where(less, middle + 1, start[todo])
            end[todo] = np.where(less, end[todo], middle)
            todo = todo[start[todo] < end[todo]]
        equal = start < stop
        found = np.flatnonzero(equal)
        equal[found] = self._low(start[found]) == want[found]
        return start, equal

    def save(self, path: str) -> None:
        for name in self.ARRAYS:
            np.save(f"{path}.{name}.npy", getattr(self, name))
        with open(f"{path}.json", "w") as out:
            json.dump({"size": self.size, "bits": self.bits}, out)

    @classmethod
    def open(cls, path: str) -> EliasFano:
        """The sequence over memory-mapped files."""
        with open(f"{path}.json") as found:
            return cls(**json.load(found), **{name: np.load(f"{path}.{name}.npy", mmap_mode="r") for name in cls.ARRAYS})


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities above 0, rounded down so that sums do not grow."""
    return np.clip(np.ceil(-np.log10(np.maximum(p, 1e-300)) / STEP - 1e-9) + 1, 1, CODES).astype(np.uint8)


def dequantise(codes: np.ndarray) -> np.ndarray:
    """The probabilities of codes; 0 for absent ones."""
    table = np.concatenate([[0.0], 10.0 ** (-np.arange(CODES) * STEP)])
    return table[codes]


class NgramTrie:
    """Words, word pairs and triples with quantised smoothed probabilities.

    Level 1 holds the first words. A level below holds, for each node above in order, the sorted words that follow
    it; a word is stored relative to its context, as context << 32 | word, so a level is one monotone sequence,
    and monotone pointers delimit the followers of each context. A pair has the probability that its context
    gives it, and the weight that it gives as a context to its own lower order; a triple has a probability.
    """

    PARTS = ("first", "second", "third", "second_from", "third_from")

    def __init__(self, p2: np.ndarray, back: np.ndarray, p3: np.ndarray, **parts: EliasFano):
        self.p2, self.back, self.p3 = p2, back, p3
        for name in self.PARTS:
            setattr(self, name, parts[name])

    @classmethod
    def build(cls, pairs: np.ndarray, p2: np.ndarray, back: np.ndarray, triples: np.ndarray, p3: np.ndarray) -> NgramTrie:
        """:param pairs: sorted first << 32 | second. :param triples: sorted place in ``pairs`` << 32 | third word."""
        first, at, count = np.unique(pairs >> _U(32), return_inverse=True, return_counts=True)
        follow = np.bincount((triples >> _U(32)).astype(np.int64), minlength=len(pairs)) if len(pairs) else np.zeros(0, np.int64)
        run = lambda c: np.concatenate([[0], np.cumsum(c)])
        second = (at.astype(_U) << _U(32)) | (pairs & _U(0xFFFFFFFF))
        return cls(
            quantise(p2), quantise(back), quantise(p3),
            first=EliasFano.build(first, 1 << 32),
            second=EliasFano.build(second, max(1, len(first)) << 32),
            third=EliasFano.build(triples, max(1, len(pairs)) << 32),
            second_from=EliasFano.build(run(count), len(pairs) + 1),
            third_from=EliasFano.build(run(follow), len(triples) + 1),
        )

    def save(self, folder: str) -> None:
        for name in self.PARTS:
            getattr(self, name).save(os.path.join(folder, name))
        for name in ("p2", "back", "p3"):
            np.save(os.path.join(folder, f"{name}.npy"), getattr(self, name))

    @classmethod
    def open(cls, folder: str) -> NgramTrie:
        """The trie over memory-mapped levels."""
        return cls(**{n: np.load(os.path.join(folder, f"{n}.npy"), mmap_mode="r") for n in ("p2", "back", "p3")}, **{n: EliasFano.open(os.path.join(folder, n)) for n in cls.PARTS})

    def find_pairs(self, pairs: np.ndarray) -> np.ndarray:
        """The places of pairs (first << 32 | second), or -1."""
        out = np.full(len(pairs), -1, dtype=np.int64)
        words, at = np.unique(pairs >> _U(32), return_inverse=True)
        node, known = self.first.successor(words)
        if not known.any():
            return out
        lo, hi = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        lo[known], hi[known] = (self.second_from.access(node[known] + k).astype(np.int64) for k in (0, 1))
        some = np.flatnonzero(known[at])
        context = at[some]
        place, equal = self.second.successor((node[context].astype(_U) << _U(32)) | (pairs[some] & _U(0xFFFFFFFF)), lo[context], hi[context])
        out[some[equal]] = place[equal]
        return out

    def find_triples(self, pair: np.ndarray, third: np.ndarray) -> np.ndarray:
        """The places of triples, each a place of a pair (-1: unknown) and a word; or -1."""
        out = np.full(len(pair), -1, dtype=np.int64)
        some = np.flatnonzero(pair >= 0)
        if not len(some) or not self.third.size:
            return out
        contexts, at = np.unique(pair[some], return_inverse=True)
        lo, hi = (self.third_from.access(contexts + k).astype(np.int64) for k in (0, 1))
        real = hi[at] > lo[at]
        some, at = some[real], at[real]
        place, equal = self.third.successor((pair[some].astype(_U) << _U(32)) | third[some].astype(_U), lo[at], hi[at])
        out[some[equal]] = place[equal]
        return out
