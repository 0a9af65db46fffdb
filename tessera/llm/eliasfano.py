"""Elias-Fano coding of non-decreasing integers, with select structures."""

from __future__ import annotations

import struct

import numpy as np

#: One position of a set bit is sampled for each so many, as a 32-bit number.
SAMPLE = 256
#: Bits of the unary part at most, so that samples fit.
MOST_BITS = 1 << 32
HEAD = struct.Struct("<QQBQQQ")


class EliasFano:
    """``n`` non-decreasing values below ``2**63``: ``low`` bits of each packed, the rest in unary.

    ``select(i)`` finds value ``i``, and ``span(i, j)`` those from ``i`` on, from a sampled position and
    a scan of the bits after it. Space is about ``2 + log2(universe / n)`` bits a value, and an eighth
    of a bit for the samples.
    """

    def __init__(self, n: int, first: int, width: int, low: np.ndarray, high: np.ndarray, sample: np.ndarray):
        self.n, self.first, self.width, self.low, self.high, self.sample = n, first, width, low, high, sample

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        if not n:
            none = np.zeros(0, np.uint8)
            return cls(0, 0, 0, none, none, np.zeros(0, np.uint32))
        if (np.diff(values) < 0).any():
            raise ValueError("values must not decrease")
        first = int(values[0])
        rest = (values - first).astype(np.uint64)
        universe = int(rest[-1]) + 1
        width = max(0, (universe // n).bit_length() - 1)
        low = np.zeros(0, np.uint8)
        if width:
            bits = ((rest[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            low = np.packbits(bits.reshape(-1), bitorder="little")
        at = (rest >> np.uint64(width)).astype(np.int64) + np.arange(n)
        if at[-1] >= MOST_BITS:
            raise ValueError("too many values for one code")
        unary = np.zeros(int(at[-1]) + 1, np.uint8)
        unary[at] = 1
        return cls(n, first, width, low, np.packbits(unary, bitorder="little"), at[::SAMPLE].astype(np.uint32))

    def _low(self, i: int, j: int) -> np.ndarray:
        if not self.width:
            return np.zeros(j - i, np.int64)
        a, b = i * self.width, j * self.width
        bits = np.unpackbits(self.low[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a]
        return bits.reshape(-1, self.width).astype(np.int64) @ (np.int64(1) << np.arange(self.width, dtype=np.int64))

    def select(self, i: int) -> int:
        """Value ``i``."""
        return int(self.span(i, i + 1)[0])

    def span(self, i: int, j: int) -> np.ndarray:
        """Values ``i`` to ``j``; reads the unary part from the sampled bit before value ``i`` onward, as far as needed."""
        if not 0 <= i < j <= self.n:
            raise IndexError((i, j))
        at, before = int(self.sample[i // SAMPLE]), i - i % SAMPLE
        byte, skip, step, found = at // 8, at % 8, 64 + (j - before) // 4, np.zeros(0, np.int64)
        while len(found) < j - before:
            bits = np.unpackbits(self.high[byte : byte + step], bitorder="little")
            bits[:skip] = 0
            found = np.concatenate([found, np.flatnonzero(bits) + byte * 8])
            byte, skip, step = byte + step, 0, step * 2
        high = found[i - before : j - before] - np.arange(i, j)
        return self.first + (high << self.width) + self._low(i, j)

    def values(self) -> np.ndarray:
        return self.span(0, self.n) if self.n else np.zeros(0, np.int64)

    def to_bytes(self) -> bytes:
        first = self.first & (2**64 - 1)
        return HEAD.pack(self.n, first, self.width, len(self.low), len(self.high), len(self.sample)) + self.low.tobytes() + self.high.tobytes() + self.sample.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, first, width, lows, highs, samples = HEAD.unpack_from(data)
        at = HEAD.size
        low = np.frombuffer(data, np.uint8, lows, at)
        high = np.frombuffer(data, np.uint8, highs, at + lows)
        sample = np.frombuffer(data, "<u4", samples, at + lows + highs)
        return cls(n, first - 2**64 if first >= 2**63 else first, width, low, high, sample)
