"""Elias-Fano sequences and a two-level n-gram trie in memory-mapped arrays, all lookups on whole arrays at once."""

from __future__ import annotations

import mmap
import struct

import numpy as np

#: Bit positions of the k-th one of each byte.
_NTH = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _ones = [i for i in range(8) if _b >> i & 1]
    _NTH[_b, : len(_ones)] = _ones


def mapped(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays' copies in one anonymous memory map."""
    starts, size = [], 0
    for a in arrays:
        starts.append(size)
        size += -(-a.nbytes // 8) * 8
    region = mmap.mmap(-1, max(size, 8))
    out = []
    for a, at in zip(arrays, starts, strict=True):
        view = np.frombuffer(region, a.dtype, a.size, at)
        view[:] = a.ravel()
        out.append(view)
    return out


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """width bits of each value, end to end, with 16 bytes behind."""
    out = np.zeros((len(values) * width + 7) // 8 + 16, np.uint8)
    if width and len(values):
        step = 8 * max(1, (1 << 20) // (8 * width))  # a multiple of 8 values fills whole bytes
        for lo in range(0, len(values), step):
            part = np.ascontiguousarray(values[lo : lo + step].astype("<u8")).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(part, axis=1, bitorder="little")[:, :width]
            packed = np.packbits(bits.ravel(), bitorder="little")
            at = lo * width // 8
            out[at : at + len(packed)] = packed
    return out


class EliasFano:
    """A non-decreasing sequence of n numbers below a universe, in about 2 + log2(universe / n) bits each."""

    def __init__(self, parts: list[np.ndarray], n: int, width: int):
        self.low, self.words, self.ones, self.zeros = parts
        self.n, self.width = n, width

    @classmethod
    def arrays(cls, values: np.ndarray, universe: int) -> tuple[list[np.ndarray], int, int]:
        v = np.asarray(values, np.uint64)
        n = len(v)
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        high = (v >> np.uint64(width)).astype(np.int64)
        length = n + int(universe >> width) + 2
        bits = np.zeros(-(-length // 64) * 64, bool)
        bits[high + np.arange(n)] = True
        words = np.packbits(bits, bitorder="little").view("<u8").astype(np.uint64)
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))
        zeros = np.arange(len(ones)) * 64 - ones
        return [_pack(v & np.uint64((1 << width) - 1), width), words, ones, zeros], n, width

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        parts, n, width = cls.arrays(values, universe)
        return cls(mapped(parts), n, width)

    def _select(self, k: np.ndarray, ranks: np.ndarray, flip: bool) -> np.ndarray:
        word = np.searchsorted(ranks, k, "right") - 1
        rest = k - ranks[word]
        bytes_ = self.words[word].view(np.uint8).reshape(-1, 8)
        if flip:
            bytes_ = ~bytes_
        upto = np.cumsum(np.bitwise_count(bytes_), axis=1, dtype=np.int64)
        b = (upto <= rest[:, None]).sum(1)
        row = np.arange(len(k))
        before = np.where(b > 0, upto[row, np.maximum(b, 1) - 1], 0)
        return word * 64 + b * 8 + _NTH[bytes_[row, b], rest - before]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        first = at >> 3
        out = np.zeros(len(i), np.uint64)
        for k in range(8):
            out |= self.low[first + k].astype(np.uint64) << np.uint64(8 * k)
        shift = (at & 7).astype(np.uint64)
        out >>= shift
        if self.width > 56:
            spill = self.low[first + 8].astype(np.uint64) << (np.uint64(64) - np.maximum(shift, np.uint64(1)))
            out = np.where(shift > 0, out | spill, out)
        return out & np.uint64((1 << self.width) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        high = (self._select(i, self.ones, False) - i).astype(np.uint64)
        return (high << np.uint64(self.width)) | self._lows(i)

    def successor(self, x: np.ndarray, start: np.ndarray | None = None, stop: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first number >= x in the range start:stop, whether it equals x). x below the universe."""
        x = np.asarray(x, np.uint64)
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        high = (x >> np.uint64(self.width)).astype(np.int64)
        want = x & np.uint64((1 << self.width) - 1)
        lo = np.where(high > 0, self._select(np.maximum(high - 1, 0), self.zeros, True) + 1, 0) - high
        hi = self._select(high, self.zeros, True) - high
        if start is not None:
            lo, hi = np.maximum(lo, start), np.minimum(hi, stop)
        end = hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._lows(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        same = lo < end
        at = np.flatnonzero(same)
        same[at] = self._lows(lo[at]) == want[at]
        return lo, same


class Quantiser:
    """Logarithms in `steps` even steps from `least` to 0, as unsigned 16-bit codes."""

    def __init__(self, least: float, steps: int = 65535):
        self.least, self.step = least, -least / steps

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.rint((np.clip(x, self.least, 0) - self.least) / self.step).astype(np.uint16)

    def decode(self, code: np.ndarray) -> np.ndarray:
        return self.least + code.astype(np.float64) * self.step


PROBABILITY = Quantiser(-20.0)


class Trie:
    """Bigrams by context: sorted contexts and words, monotone pointers from contexts to children, and codes.

    A child is stored as its context's number times the number of words plus its word's number, so the whole level is
    one monotone sequence, and a child is found by successor search between its context's pointers.
    """

    SEQUENCES = ("contexts", "words", "pointers", "children")

    def __init__(self, sequences: list[EliasFano], probability: np.ndarray, backoff: np.ndarray):
        self.contexts, self.words, self.pointers, self.children = sequences
        self.probability, self.backoff = probability, backoff

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, log_probability: np.ndarray, log_backoff: np.ndarray) -> Trie:
        """context, word: hashes of the n-grams sorted by both; log_backoff: one for each distinct context in order."""
        contexts, number = np.unique(context, return_inverse=True)
        words, rank = np.unique(word, return_inverse=True)
        nw = max(1, len(words))
        pointers = np.searchsorted(number, np.arange(len(contexts) + 1))
        key = number.astype(np.int64) * nw + rank
        made = [EliasFano.arrays(v, u) for v, u in ((contexts, 1 << 64), (words, 1 << 64), (pointers, len(key) + 1), (key, max(1, len(contexts)) * nw))]
        flat = mapped([a for parts, _, _ in made for a in parts] + [PROBABILITY.encode(log_probability), PROBABILITY.encode(log_backoff)])
        return cls([EliasFano(flat[4 * i : 4 * i + 4], n, w) for i, (_, n, w) in enumerate(made)], flat[-2], flat[-1])

    def look_up(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(smoothed n-gram probability, 0 if unseen; backoff weight, 1 if the context is unseen)."""
        ucon, icon = np.unique(context, return_inverse=True)
        uword, iword = np.unique(word, return_inverse=True)
        c, known_c = self.contexts.successor(ucon)
        w, known_w = self.words.successor(uword)
        backoff = np.ones(len(ucon))
        backoff[known_c] = 10 ** PROBABILITY.decode(self.backoff[c[known_c]])
        seen = np.flatnonzero(known_c[icon] & known_w[iword])
        p = np.zeros(len(context))
        if len(seen):
            own = np.flatnonzero(known_c)
            start, stop = np.zeros(len(ucon), np.int64), np.zeros(len(ucon), np.int64)
            start[own], stop[own] = (self.pointers.access(c[own] + k).astype(np.int64) for k in (0, 1))
            at = icon[seen]
            key = c[at] * max(1, self.words.n) + w[iword[seen]]
            i, there = self.children.successor(key.astype(np.uint64), start[at], stop[at])
            p[seen[there]] = 10 ** PROBABILITY.decode(self.probability[i[there]])
        return p, backoff[icon]

    def to_bytes(self) -> bytes:
        parts = [a for s in (self.contexts, self.words, self.pointers, self.children) for a in (s.low, s.words, s.ones, s.zeros)] + [self.probability, self.backoff]
        sizes = [x for s in (self.contexts, self.words, self.pointers, self.children) for x in (s.n, s.width)] + [a.size for a in parts]
        return struct.pack(f"<{len(sizes)}q", *sizes) + b"".join(a.tobytes() for a in parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> Trie:
        sizes = struct.unpack_from("<26q", data)
        kinds = [np.uint8, np.uint64, np.int64, np.int64] * 4 + [np.uint16, np.uint16]
        at, parts = 26 * 8, []
        for kind, n in zip(kinds, sizes[8:], strict=True):
            parts.append(np.frombuffer(data, kind, n, at))
            at += parts[-1].nbytes
        parts = mapped(parts)
        return cls([EliasFano(parts[4 * i : 4 * i + 4], sizes[2 * i], sizes[2 * i + 1]) for i in range(4)], parts[-2], parts[-1])
