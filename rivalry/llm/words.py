"""Words of many texts at once, as arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes hashed in one go; words and texts may be longer.
BLOCK = 1 << 19
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, BLOCK + 1), _powers(pow(_BASE, -1, 1 << 64), BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of a list of UTF-8 texts: hash, first byte, end and text number of each."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = b"\n".join(texts) + b"\n"
        data = np.frombuffer(self.data, np.uint8)
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(data) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_ends = np.cumsum(sizes)
        self.text = np.searchsorted(self.text_ends, self.starts, "right")
        #: words of text i are first[i]:first[i + 1]
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.hash = self._hash(_LOWER[data] if lower else data)

    def _hash(self, data: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        i, n = 0, len(out)
        while i < n:
            base = self.starts[i]
            j = int(np.searchsorted(self.ends, base + BLOCK, "right"))
            if j <= i:  # one word longer than a block
                out[i] = xxhash.xxh3_64_intdigest(data[base : self.ends[i]].tobytes())
                i += 1
                continue
            part = data[base : self.ends[j - 1]]
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * _UP[: len(part)], dtype=np.uint64)))
            s, e = self.starts[i:j] - base, self.ends[i:j] - base
            out[i:j] = mix((sums[e] - sums[s]) * _DOWN[s] + (e - s).astype(np.uint64))
            i = j
        return out


def windows(h: np.ndarray, size: int, salt: int = 1) -> np.ndarray:
    """Hash of each `size` consecutive words of h (len(h) - size + 1 of them); another salt gives another hash."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = (0xD1342543DE82EF95 + 0x632BE59BD9B4E019 * 2 * salt) % (1 << 64) | 1
    out = np.zeros(n, np.uint64)
    factor = 1
    for k in range(size):
        out += h[k : k + n] * np.uint64(factor)
        factor = factor * base % (1 << 64)
    return mix(out ^ np.uint64(salt))


def chunks(rows: list[bytes], most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes, or one row if it is longer."""
    start, held = 0, 0
    for i, x in enumerate(rows):
        if i > start and held + len(x) > most:
            yield start, i
            start, held = i, 0
        held += len(x)
    if start < len(rows):
        yield start, len(rows)
