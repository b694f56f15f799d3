"""Minwise hashing (Broder 1997) of many texts at once, in numpy: texts lie end to end in flat arrays of word hashes."""

import numpy as np
import xxhash

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, kept for those that were asked for; it starts anew before it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def flat(texts: list[list[str]], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts, words of each)."""
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return np.fromiter(map(known.__getitem__, (w for t in texts for w in t)), dtype=np.uint64, count=int(size.sum())), size


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def shingles(ids: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the runs of n words, runs of each text); a shorter text is one run, an empty one too."""
    runs = np.maximum(size - n + 1, 1)
    first = np.cumsum(size) - size
    start = np.arange(int(runs.sum())) + np.repeat(first - (np.cumsum(runs) - runs), runs)
    last = np.repeat(first + size, runs)
    padded = np.append(ids, np.zeros(n, dtype=np.uint64))
    out = np.zeros(len(start), dtype=np.uint64)
    for k in range(n):
        word = padded[np.minimum(start + k, len(padded) - 1)]
        out = mixed(out ^ np.where(start + k < last, word + _GOLDEN, np.uint64(k)))
    return out, runs


def in_parts(ids: np.ndarray, size: np.ndarray, parts: int) -> np.ndarray:
    """Each word with the part of its text in which it stands."""
    place = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
    return mixed(ids ^ ((place * parts // np.repeat(size, size)).astype(np.uint64) * _GOLDEN))


def least(tokens: np.ndarray, size: np.ndarray, hashes: int, seed: int) -> np.ndarray:
    """(texts, hashes): the least values of as many random permutations over the tokens of each text; no text is without one."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, hashes, dtype=np.uint64)
    first = np.cumsum(size) - size
    out = np.empty((len(size), hashes), dtype=np.uint64)
    for k, (x, y) in enumerate(zip(a, b)):
        out[:, k] = np.minimum.reduceat(tokens * x + y, first) >> np.uint64(16) if len(size) else 0
    return out
