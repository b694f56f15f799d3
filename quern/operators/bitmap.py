"""Compressed bitmaps over dictionary codes (numpy).

Codes are split into chunks of 2^16 by their upper bits. A chunk holds a sorted uint16 array while it has at most
4096 members, else 1024 words of 64 bits, whichever is smaller; empty chunks are not stored.
"""

import numpy as np

CHUNK_BITS = 16
ARRAY_MAX = 4096


def _dense(low: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << CHUNK_BITS, dtype=np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _members(chunk: np.ndarray) -> np.ndarray:
    if chunk.dtype == np.uint16:
        return chunk
    return np.flatnonzero(np.unpackbits(chunk.view(np.uint8), bitorder="little")).astype(np.uint16)


def _pack(low: np.ndarray) -> np.ndarray:
    return low if len(low) <= ARRAY_MAX else _dense(low)


class Bitmap:
    """An immutable set of non-negative integers."""

    def __init__(self, chunks: dict[int, np.ndarray]):
        self.chunks = chunks

    @classmethod
    def of(cls, codes: np.ndarray) -> "Bitmap":
        codes = np.unique(np.asarray(codes, dtype=np.int64))
        high = codes >> CHUNK_BITS
        starts = np.flatnonzero(np.r_[True, high[1:] != high[:-1]]) if len(codes) else []
        ends = np.r_[starts[1:], len(codes)] if len(codes) else []
        return cls({int(high[a]): _pack((codes[a:b] & 0xFFFF).astype(np.uint16)) for a, b in zip(starts, ends)})

    def and_not(self, other: "Bitmap") -> "Bitmap":
        """Members of self that other lacks."""
        out = {}
        for high, mine in self.chunks.items():
            theirs = other.chunks.get(high)
            if theirs is None:
                out[high] = mine
                continue
            if mine.dtype == np.uint16:
                if theirs.dtype == np.uint16:
                    left = np.setdiff1d(mine, theirs, assume_unique=True)
                else:
                    left = mine[(theirs[mine >> 6] >> (mine & 63).astype(np.uint64)) & np.uint64(1) == 0]
            else:
                left = _members(mine & ~(theirs if theirs.dtype == np.uint64 else _dense(theirs)))
            if len(left):
                out[high] = _pack(left)
        return Bitmap(out)

    def union(self, other: "Bitmap") -> "Bitmap":
        out = dict(self.chunks)
        for high, theirs in other.chunks.items():
            out[high] = _pack(np.union1d(_members(out[high]), _members(theirs))) if high in out else theirs
        return Bitmap(out)

    def decode(self) -> np.ndarray:
        """The members in ascending order."""
        parts = [(high << CHUNK_BITS) + _members(self.chunks[high]).astype(np.int64) for high in sorted(self.chunks)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)

    def __len__(self) -> int:
        return sum(len(_members(c)) for c in self.chunks.values())

    def nbytes(self) -> int:
        return sum(c.nbytes for c in self.chunks.values())
