"""Word and shingle hashes of whole texts, computed array-wise inside a task.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. Texts come as UTF-8 bytes. A word's hash is a
sum of random table entries per byte times powers of an odd number, mixed: 64 bits, the same in
every task. Bytes are gone through in blocks, so temporary memory does not grow with a text; kept are
eight bytes per word.
"""

import numpy as np
import pyarrow.compute as pc

BLOCK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240917))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15 | 1, np.uint64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    global _POWER
    if n > len(_POWER):
        _POWER = np.cumprod(np.full(2 * n, 0x9E3779B97F4A7C15 | 1, np.uint64))
    return _POWER


def _block(data: np.ndarray, lower: bool):
    space = _IS_SPACE[data]
    word = ~space
    starts = np.flatnonzero(word & np.concatenate(([True], space[:-1])))
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    values = _BYTE[_LOWER[data[starts[0]:]] if lower else data[starts[0]:]]
    values *= _powers(int(lengths.max()))[place]
    values[space[starts[0]:]] = 0
    return starts, mix(np.add.reduceat(values, starts - starts[0]))


def hash_words(data: np.ndarray, lower: bool = False):
    """Start offsets and hashes of the words of a byte array."""
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        if end < len(data):  # a block ends behind a space, or goes on until there is one
            last = np.flatnonzero(_IS_SPACE[data[at:end]])
            while not len(last) and end < len(data):
                start, end = end, min(end + BLOCK, len(data))
                last = np.flatnonzero(_IS_SPACE[data[start:end]])
                last = last + (start - at)
            end = at + int(last[-1]) + 1 if len(last) else len(data)
        s, h = _block(data[at:end], lower)
        starts.append(s + at)
        hashes.append(h)
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


class Texts:
    """Words of several texts: those of text ``i`` are ``hashes[first[i]:first[i + 1]]``."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = np.frombuffer(b"\n".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(sizes + 1)))  # each text and the break behind it
        self.starts, self.hashes = hash_words(self.data, lower)
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self):
        return len(self.offsets) - 1

    def words(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i]:self.first[i + 1]]


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n consecutive words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = words[:len(words) - n + 1] * _PLACE[0]
    for k in range(1, n):
        total = total + words[k:len(words) - n + 1 + k] * _PLACE[k]
    return mix(total)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted set of the n-word shingles; a shorter non-empty sequence is one shingle."""
    if len(words) >= n:
        return np.unique(windows(words, n))
    return windows(words, len(words)) if len(words) else np.zeros(0, np.uint64)


def parts(batches, limit: int = 2 << 20):
    """Split Arrow batches of ``(id, text as binary, ...)`` into slices of at most about ``limit`` bytes,
    a single longer text alone, so that temporary arrays stay small."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            total = np.cumsum(sizes[at:at + 4096])
            n = max(1, int(np.searchsorted(total, limit)))
            n = min(n, batch.num_rows - at)
            yield batch.slice(at, n)
            at += n
