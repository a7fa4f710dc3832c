"""Names of words and hashes of spans, computed for whole arrays."""

import numpy as np
import xxhash

BASE = np.uint64(0x9E3779B97F4A7C15)
OTHER_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


class WordNames(dict):
    """64-bit names of words (bytes), the same in every process; keeps those it has met."""

    most = 400_000

    def __missing__(self, word: bytes) -> int:
        name = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = name
        return name

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Stretches of characters other than U+0020 and U+0009 to U+000D; ``lower``: A-Z as a-z."""
    if not text:
        return []
    raw = text.encode()
    return (raw.lower() if lower else raw).split()  # bytes split at just these characters


_tables: dict[int, np.ndarray] = {}


def powers(most: int, base: np.uint64 = BASE) -> np.ndarray:
    """base ** 0 to base ** most, modulo 2 ** 64."""
    table = _tables.get(int(base))
    if table is None or len(table) <= most:
        table = np.full(max(most + 1, 1 << 12), base, dtype=np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        if len(table) <= 1 << 22:
            _tables[int(base)] = table
    return table[: most + 1]


def prefix_hashes(values: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """p with p[j] - p[i] * base ** (j - i) being the hash of values i to j, modulo 2 ** 64."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.add.accumulate((values + np.uint64(1)) * powers(len(values), inverse)[1:], out=sums[1:])
    return sums * powers(len(values), base)


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """Hashes of the spans from ``start`` to ``end``; spans of other lengths have other hashes."""
    length = end - start
    return mixed(prefix[end] - prefix[start] * powers(int(length.max(initial=0)), base)[length], length)


def mixed(hashes: np.ndarray, salt) -> np.ndarray:
    """Every bit of the result depends on every bit of hash and salt."""
    h = hashes + np.asarray(salt).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))
