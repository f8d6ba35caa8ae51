"""Elias-Fano coding of a non-decreasing sequence, with select.

n numbers below u take about 2 + log2(u / n) bits each: the low bits of each
number are stored as they are, the high bits as one bit vector with a set bit
at (high part + position).  ``select`` finds the i-th set bit from a sample of
every 256th one, so a number is read without decoding the rest and without a
table of 64-bit offsets.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QQQB7x")  # numbers, bytes of low bits, bytes of high bits, low bits of a number


def ef_encode(values: np.ndarray) -> bytes:
    """Non-decreasing unsigned numbers as bytes (a multiple of 8 long)."""
    v = np.asarray(values, dtype=np.uint64)
    n = len(v)
    if not n:
        return _HEAD.pack(0, 0, 0, 0)
    low_bits = max(0, (int(v[-1]) // n).bit_length() - 1)
    low = np.zeros((n, low_bits), dtype=np.uint8)
    for b in range(low_bits):
        low[:, b] = (v >> np.uint64(b)) & np.uint64(1)
    ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1, dtype=np.uint8)
    high[ones] = 1
    low_bytes, high_bytes = np.packbits(low.ravel(), bitorder="little"), np.packbits(high, bitorder="little")
    samples = ones[::SAMPLE].astype("<u4")
    out = _HEAD.pack(n, len(low_bytes), len(high_bytes), low_bits) + low_bytes.tobytes() + high_bytes.tobytes() + samples.tobytes()
    return out + b"\0" * (-len(out) % 8)


class EliasFano:
    """Reader of ``ef_encode``'s bytes."""

    def __init__(self, data: bytes | memoryview):
        self.n, n_low, n_high, self.low_bits = _HEAD.unpack_from(data)
        at = _HEAD.size
        self._low = np.frombuffer(data, np.uint8, n_low, at)
        self._high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        self._samples = np.frombuffer(data, "<u4", -(-self.n // SAMPLE), at + n_low + n_high)

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """The i-th number (from 0)."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block, rest = divmod(i, SAMPLE)
        begin = int(self._samples[block]) // 8
        end = int(self._samples[block + 1]) // 8 + 1 if block + 1 < len(self._samples) else len(self._high)
        ones = np.flatnonzero(np.unpackbits(self._high[begin:end], bitorder="little"))
        first = int(np.searchsorted(ones, int(self._samples[block]) - 8 * begin))
        high = 8 * begin + int(ones[first + rest]) - i
        bit = i * self.low_bits
        part = np.unpackbits(self._low[bit // 8:(bit + self.low_bits + 7) // 8], bitorder="little")[bit % 8:bit % 8 + self.low_bits]
        return high << self.low_bits | sum(int(x) << b for b, x in enumerate(part))

    def decode(self) -> np.ndarray:
        """All numbers as uint64."""
        high = np.flatnonzero(np.unpackbits(self._high, bitorder="little"))[:self.n] - np.arange(self.n)
        out = high.astype(np.uint64) << np.uint64(self.low_bits)
        low = np.unpackbits(self._low, bitorder="little")[:self.n * self.low_bits].reshape(self.n, self.low_bits)
        for b in range(self.low_bits):
            out |= low[:, b].astype(np.uint64) << np.uint64(b)
        return out
