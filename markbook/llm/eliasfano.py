"""Elias-Fano code of a non-decreasing sequence, with a sampled select structure.

A value is split into l low bits, kept in a packed array, and the rest, kept as gaps in unary. The sequence
takes about 2 + log2(largest / count) bits a value. ``select`` starts at the nearest sampled one-bit (an
unsigned 32-bit position for every 256 values) and takes the one-bits from there to the next sample together, so no table
of 64-bit offsets exists and no bit is read by itself.
"""

from __future__ import annotations

import struct

import numpy as np

EVERY, SLICE = 256, 1 << 16
_HEAD = struct.Struct("<QQBQQQ")  # count, largest, low bits; bytes of the low, high and sample parts


def encode(values: np.ndarray) -> bytes:
    """The code of non-negative, non-decreasing ``values``."""
    v = np.ascontiguousarray(values, dtype=np.uint64)
    n, most = len(v), int(v[-1]) if len(v) else 0
    bits = max(0, (most // n).bit_length() - 1) if n else 0
    low = np.zeros((n * bits + 7) // 8, np.uint8)
    for i in range(0, n if bits else 0, SLICE):  # whole bytes, as SLICE is a multiple of 8
        part = v[i : i + SLICE]
        packed = np.packbits(((part[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        low[i * bits // 8 : i * bits // 8 + len(packed)] = packed
    at = ((v >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
    high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
    high[at] = 1
    high = np.packbits(high, bitorder="little")
    samples = at[::EVERY].astype("<u4")
    return _HEAD.pack(n, most, bits, len(low), len(high), samples.nbytes) + low.tobytes() + high.tobytes() + samples.tobytes()


class Reader:
    """Random and sequential access to an encoded sequence."""

    def __init__(self, data: bytes | memoryview):
        self.n, self.most, self.bits, nl, nh, ns = _HEAD.unpack_from(data, 0)
        body = np.frombuffer(data, np.uint8, nl + nh + ns, _HEAD.size)
        self.low, self.high, self.samples = body[:nl], body[nl : nl + nh], body[nl + nh :].view("<u4")

    def __len__(self) -> int:
        return self.n

    def _low(self, lo: int, hi: int) -> np.ndarray:
        """The low bits of values lo to hi - 1."""
        first, end = lo * self.bits, hi * self.bits
        flat = np.unpackbits(self.low[first // 8 : (end + 7) // 8], bitorder="little")[first % 8 :][: end - first].reshape(hi - lo, self.bits)
        return (flat.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def run(self, lo: int, hi: int) -> np.ndarray:
        """Select of all indices from lo to hi - 1: one-bits between the samples around them."""
        if not 0 <= lo <= hi <= self.n:
            raise IndexError((lo, hi))
        if lo == hi:
            return np.zeros(0, np.uint64)
        first, after = lo // EVERY, (hi - 1) // EVERY + 1
        start = int(self.samples[first]) // 8
        end = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[start:end], bitorder="little")) + 8 * start
        ones = ones[ones >= int(self.samples[first])][lo - first * EVERY : hi - first * EVERY].astype(np.uint64)
        return ((ones - np.arange(lo, hi, dtype=np.uint64)) << np.uint64(self.bits)) | self._low(lo, hi)

    def select(self, i: int) -> int:
        """The value at index i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.run(i, i + 1)[0])

    def all(self) -> np.ndarray:
        """Every value, decoded together."""
        return self.run(0, self.n)
