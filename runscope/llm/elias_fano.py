"""Elias-Fano code of a non-decreasing sequence, with select samples, on numpy arrays."""

from __future__ import annotations

import struct

import numpy as np

#: Every so many values, the position of the value's bit is kept, so that a select reads a short stretch only.
SAMPLE = 256
_HEAD = "<4sQQB"
_MAGIC = b"EF01"


class EliasFano:
    """n values in [0, universe]: the low l bits packed, the high parts as a unary bit vector.

    About 2 + log2(universe / n) bits a value, plus 32 bits for each SAMPLE values. ``select`` finds one bits of the
    high vector from the nearest samples.
    """

    def __init__(self, n: int, universe: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.universe, self.low_bits = n, universe, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def encode(cls, values) -> "EliasFano":
        v = np.asarray(values, dtype=np.int64)
        n = len(v)
        if n and (v[0] < 0 or np.any(np.diff(v) < 0)):
            raise ValueError("values must be non-negative and non-decreasing")
        universe = int(v[-1]) if n else 0
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        bits = (v[:, None] >> np.arange(low_bits)) & 1
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        at = (v >> low_bits) + np.arange(n)
        high = np.zeros((int(at[-1]) if n else 0) + 1, np.uint8)
        high[at] = 1
        return cls(n, universe, low_bits, low.tobytes(), np.packbits(high, bitorder="little").tobytes(),
                   at[::SAMPLE].astype("<u4").tobytes())

    def select(self, places: np.ndarray) -> np.ndarray:
        """Positions of the one bits of the high vector with these numbers (ascending): those after a sample are found
        in the stretch up to the next sample, nothing else is read."""
        places = np.asarray(places, dtype=np.int64)
        if len(places) and not (0 <= places[0] and places[-1] < self.n and np.all(np.diff(places) >= 0)):
            raise IndexError("numbers of values, ascending")
        out = np.empty(len(places), np.int64)
        groups, first = np.unique(places // SAMPLE, return_index=True)
        for g, lo, hi in zip(groups.tolist(), first.tolist(), [*first[1:].tolist(), len(places)]):
            at = int(self.samples[g])
            end = int(self.samples[g + 1]) if g + 1 < len(self.samples) else 8 * len(self.high)
            ones = np.flatnonzero(np.unpackbits(self.high[at // 8:-(-end // 8)], bitorder="little"))
            ones = ones[np.searchsorted(ones, at % 8):]  # those before the sample belong to earlier values
            out[lo:hi] = at // 8 * 8 + ones[places[lo:hi] % SAMPLE]
        return out

    def at(self, places: np.ndarray) -> np.ndarray:
        """The values with these numbers (ascending)."""
        places = np.asarray(places, dtype=np.int64)
        high = self.select(places) - places
        bits = places[:, None] * self.low_bits + np.arange(self.low_bits)
        low = (self.low[bits // 8].astype(np.int64) >> (bits % 8) & 1) << np.arange(self.low_bits)
        return high << self.low_bits | low.sum(axis=1, dtype=np.int64)

    def __getitem__(self, i: int) -> int:
        return int(self.at(np.array([i]))[0])

    def all(self) -> np.ndarray:
        """All values at once."""
        return self.at(np.arange(self.n))

    def to_bytes(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]
        return struct.pack(_HEAD, _MAGIC, self.n, self.universe, self.low_bits) + struct.pack("<3Q", *map(len, parts)) \
            + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> "EliasFano":
        magic, n, universe, low_bits = struct.unpack_from(_HEAD, data)
        if magic != _MAGIC:
            raise ValueError("not an Elias-Fano block")
        sizes, at, parts = struct.unpack_from("<3Q", data, struct.calcsize(_HEAD)), struct.calcsize(_HEAD) + 24, []
        for size in sizes:
            parts.append(data[at:at + size])
            at += size
        return cls(n, universe, low_bits, *parts)
