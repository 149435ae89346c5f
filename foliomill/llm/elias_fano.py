"""Elias-Fano coded monotone sequences and an n-gram trie over them, in one buffer that can be memory-mapped.

All look-ups are vectorised: a query is an array of values.
"""

from __future__ import annotations

import mmap
import os
import struct

import numpy as np

U1 = np.uint64(1)


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit values in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = cls._packed(values & np.uint64((1 << bits) - 1), bits)
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        words = ((int(at[-1]) if n else 0) >> 6) + 2
        flags = np.zeros(words * 64, np.uint8)
        flags[at] = 1
        high = np.packbits(flags, bitorder="little").view("<u8").astype(np.uint64)
        return cls(n, bits, low, high, cls._counted(high))

    @staticmethod
    def _counted(high: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])

    @staticmethod
    def _packed(low: np.ndarray, bits: int) -> np.ndarray:
        out = np.zeros(len(low) * bits // 64 + 2, np.uint64)
        if bits:
            at = np.arange(len(low), dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(out, word, low << shift)
            over = np.flatnonzero(shift + np.uint64(bits) > np.uint64(64))
            np.bitwise_or.at(out, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
        return out

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        out = self.low[word] >> shift
        out |= np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return out & np.uint64((1 << self.low_bits) - 1)

    @staticmethod
    def _select(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Place of the rank-th set bit (from 0) of each word."""
        place = np.zeros(len(words), np.uint64)
        rest = rank.astype(np.uint64)
        for half in (32, 16, 8, 4, 2, 1):
            here = np.bitwise_count((words >> place) & np.uint64((1 << half) - 1)).astype(np.uint64)
            up = rest >= here
            rest = np.where(up, rest - here, rest)
            place = np.where(up, place + np.uint64(half), place)
        return place.astype(np.int64)

    def select1(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, side="right") - 1
        return word * 64 + self._select(self.high[word], i - self.ones[word])

    def select0(self, i: np.ndarray) -> np.ndarray:
        """Place of the i-th zero; past the end, the end."""
        word = np.minimum(np.searchsorted(self.zeros, i, side="right") - 1, len(self.high) - 1)
        rank = i - self.zeros[word]
        inside = rank < 64 - np.bitwise_count(self.high[word])
        return np.where(inside, word * 64 + self._select(~self.high[word], np.where(inside, rank, 0)), len(self.high) * 64)

    def access(self, i: np.ndarray) -> np.ndarray:
        return ((self.select1(i) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self.lows(i)

    def successor(self, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least index in [first, last) with an element >= value; ``last`` if none. The high part bounds the search, halving of lows ends it."""
        h = np.minimum(values >> np.uint64(self.low_bits), np.uint64(len(self.high) * 64)).astype(np.int64)
        before = self.select0(np.maximum(h - 1, 0))
        begin = np.where(h == 0, 0, np.where(before < len(self.high) * 64, before + 1 - h, self.n))
        end = self.select0(h) - h
        low, high = np.clip(begin, first, last), np.clip(end, first, last)
        want = values & np.uint64((1 << self.low_bits) - 1)
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) // 2
            less = self.lows(mid) < want[live]
            low[live[less]] = mid[less] + 1
            high[live[~less]] = mid[~less]
            live = live[low[live] < high[live]]
        return low

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.uint64), self.low, self.high]

    @classmethod
    def from_parts(cls, parts: list[np.ndarray]) -> EliasFano:
        return cls(int(parts[0][0]), int(parts[0][1]), parts[1], parts[2], cls._counted(parts[2]))


#: log10 of a probability in steps of 1/25; code 0 is absent.
STEP = 25.0


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(255 + np.rint(np.log10(p) * STEP), 1, 255).astype(np.uint8)


LEVELS = np.concatenate([[0.0], 10 ** ((np.arange(1, 256) - 255) / STEP)])


class Trie:
    """Three levels: words, their followers, and those followers' followers.

    A child is stored as context * span + word, so that the sequence of a whole level is monotone
    and a word is searched relative to its context's base, between the context's two pointers.
    ``two`` holds the quantised smoothed share of each bigram, ``keep`` the quantised weight that
    its context leaves to shorter ones, ``three`` the share of each trigram.
    """

    def __init__(self, span: int, one: EliasFano, to_two: EliasFano, level_two: EliasFano, to_three: EliasFano, level_three: EliasFano, two: np.ndarray, keep: np.ndarray, three: np.ndarray):
        self.span, self.one, self.to_two, self.level_two, self.to_three, self.level_three = span, one, to_two, level_two, to_three, level_three
        self.two, self.keep, self.three = two, keep, three

    @classmethod
    def build(cls, bigrams: np.ndarray, counts: np.ndarray, contexts: np.ndarray, words: np.ndarray, counts3: np.ndarray, totals: np.ndarray, prior: float) -> Trie:
        """``bigrams`` sorted first << 32 | second with ``counts``; trigrams sorted by (index of bigram, word); ``totals``: count of each bigram's first word."""
        first, second = bigrams >> np.uint64(32), bigrams & np.uint64(0xFFFFFFFF)
        span = int(max(second.max(initial=0), words.max(initial=0))) + 1
        one, at, rank = np.unique(first, return_index=True, return_inverse=True)
        level_two = EliasFano.of(rank.astype(np.uint64) * np.uint64(span) + second)
        level_three = EliasFano.of(contexts.astype(np.uint64) * np.uint64(span) + words.astype(np.uint64))
        to_two = EliasFano.of(np.append(at, len(bigrams)).astype(np.uint64))
        to_three = EliasFano.of(np.searchsorted(contexts, np.arange(len(bigrams) + 1)).astype(np.uint64))
        return cls(span, EliasFano.of(one), to_two, level_two, to_three, level_three, quantised(counts / (totals + prior)), quantised(prior / (counts + prior)), quantised(counts3 / (counts[contexts] + prior)))

    @staticmethod
    def _child(level: EliasFano, pointers: EliasFano, span: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Index of a context's child, -1 if it has no such."""
        out = np.full(len(context), -1, np.int64)
        ok = np.flatnonzero((context >= 0) & (word < span))
        if not len(ok) or not level.n:
            return out
        c = context[ok]
        first, last = (pointers.access(c + k).astype(np.int64) for k in (0, 1))
        value = c.astype(np.uint64) * np.uint64(span) + word[ok].astype(np.uint64)
        at = level.successor(value, first, last)
        hit = np.flatnonzero(at < last)
        hit = hit[level.access(at[hit]) == value[hit]]
        out[ok[hit]] = at[hit]
        return out

    def bigram(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        if not self.one.n:
            return np.full(len(first), -1, np.int64)
        value = first.astype(np.uint64)
        n = np.full(len(value), self.one.n, np.int64)
        at = self.one.successor(value, np.zeros(len(value), np.int64), n)
        context = np.full(len(value), -1, np.int64)
        hit = np.flatnonzero(at < n)
        hit = hit[self.one.access(at[hit]) == value[hit]]
        context[hit] = at[hit]
        return self._child(self.level_two, self.to_two, self.span, context, second)

    def trigram(self, bigram: np.ndarray, third: np.ndarray) -> np.ndarray:
        return self._child(self.level_three, self.to_three, self.span, bigram, third)

    def to_bytes(self) -> bytes:
        parts = [np.array([self.span], np.uint64)]
        for s in (self.one, self.to_two, self.level_two, self.to_three, self.level_three):
            parts += s.parts()
        parts += [self.two, self.keep, self.three]
        head = struct.pack(f"<{len(parts)}q", *[p.nbytes for p in parts])
        return head + b"".join(p.tobytes() + bytes(-p.nbytes % 8) for p in parts)

    @classmethod
    def over(cls, buffer) -> Trie:
        """A trie over a buffer, such as a memory-mapped file; nothing is copied."""
        sizes = struct.unpack_from("<19q", buffer)
        at, parts = 19 * 8, []
        for k, size in enumerate(sizes):
            kind = np.uint8 if k >= 16 else np.uint64
            parts.append(np.frombuffer(buffer, kind, size // np.dtype(kind).itemsize, at))
            at += size + (-size % 8)
        levels = [EliasFano.from_parts(parts[1 + 3 * k : 4 + 3 * k]) for k in range(5)]
        return cls(int(parts[0][0]), *levels, *parts[16:])

    @classmethod
    def mapped(cls, raw: bytes) -> Trie:
        """The levels in memory-mapped pages of an anonymous file; no folder is touched."""
        fd = os.memfd_create("trie")
        try:
            os.truncate(fd, len(raw))
            pages = mmap.mmap(fd, len(raw))
        finally:
            os.close(fd)
        pages[:] = raw
        return cls.over(pages)
