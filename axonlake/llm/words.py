"""Words and their hashes for the Arrow-batched operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Odd constants of a multiplicative mix (fixed values: public mixing constants of splitmix64).
MIX_1, MIX_2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value scattered."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of each word asked for; forgets all when it holds more than `limit`, so a task's memory stays bounded."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of the column; null: empty."""
    return batch.column(batch.schema.get_field_index(column)).fill_null("").cast(pa.large_binary()).to_pylist()


def split(text: bytes) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space (space, 9 to 13)."""
    return text.lower().split()


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Distinct hashes of all runs of `width` words, ascending; with fewer words the whole sequence is one; none: none."""
    if not len(hashes):
        return hashes
    n = min(width, len(hashes))
    run = np.full(len(hashes) - n + 1, n, np.uint64)
    for k in range(n):
        run = run * STEP + hashes[k : k + len(run)]
    return np.unique(mixed(run))
