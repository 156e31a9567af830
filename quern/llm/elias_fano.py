"""Elias-Fano coding of non-decreasing integers: low bits packed, high bits in unary, with a stored directory for select.

n values below u take about n * (2 + log2(u / n)) bits, against 64 n in a plain table; the directory counts the ones before every BLOCK_BYTES
of high bits in 4 bytes each. select finds a value's block there and looks at nothing else of the high bits.
"""

from __future__ import annotations

import struct

import numpy as np

HEADER = struct.Struct("<QBQQ")  # values, low bits, bytes of low bits, bytes of high bits; the directory's size follows from these
BLOCK_BYTES = 64


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, directory: bytes = b""):
        self.n, self.low_bits, self.low, self.high, self.directory = n, low_bits, low, high, directory

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"")
        if n >= 1 << 32:
            raise ValueError("the directory counts up to 2**32 values")
        if np.any(values[1:] < values[:-1]):
            raise ValueError("values must not decrease")
        low_bits = max(0, int(values[-1]) // n).bit_length()
        low_bits = max(0, low_bits - 1)
        parts = [np.unpackbits(values[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :low_bits].ravel() for at in range(0, n, 65536)]
        low = np.packbits(np.concatenate(parts), bitorder="little").tobytes()
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, dtype=np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little")
        counts = np.add.reduceat(np.bitwise_count(high).astype(np.uint32), np.arange(0, len(high), BLOCK_BYTES))
        return cls(n, low_bits, low, high.tobytes(), (counts.cumsum(dtype=np.uint32) - counts).astype("<u4").tobytes())

    def to_bytes(self) -> bytes:
        return HEADER.pack(self.n, self.low_bits, len(self.low), len(self.high)) + self.low + self.high + self.directory

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The coded values at a place in data, and the place behind them."""
        n, low_bits, low_size, high_size = HEADER.unpack_from(data, at)
        ends = np.cumsum([at + HEADER.size, low_size, high_size, -(-high_size // BLOCK_BYTES) * 4]).tolist()
        return cls(n, low_bits, *(data[a:b] for a, b in zip(ends, ends[1:]))), ends[-1]

    def select_range(self, i: int, count: int) -> np.ndarray:
        """The values from the i-th on, ``count`` of them, from the positions of as many ones among the high bits."""
        if not 0 <= i <= i + count <= self.n:
            raise IndexError(i)
        if not count:
            return np.zeros(0, dtype=np.uint64)
        before = np.frombuffer(self.directory, dtype="<u4")
        block, last = (int(np.searchsorted(before, x, side="right")) - 1 for x in (i, i + count - 1))
        bits = np.unpackbits(np.frombuffer(self.high[block * BLOCK_BYTES : (last + 1) * BLOCK_BYTES], dtype=np.uint8), bitorder="little")
        skip = i - int(before[block])
        ones = np.flatnonzero(bits)[skip : skip + count] + block * BLOCK_BYTES * 8
        values = (ones - np.arange(i, i + count)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            first, end = i * self.low_bits, (i + count) * self.low_bits
            packed = np.frombuffer(self.low[first >> 3 : (end + 7) >> 3], dtype=np.uint8)
            low = np.unpackbits(packed, bitorder="little")[first & 7 :][: end - first].reshape(count, self.low_bits)
            values |= low.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))
        return values

    def select(self, i: int) -> int:
        """The i-th value."""
        return int(self.select_range(i, 1)[0])

    def decode(self) -> np.ndarray:
        """All values."""
        return self.select_range(0, self.n)
