"""Words and shingles of a text as arrays of 64-bit hashes, for use inside tasks.

A word is a run of bytes other than space and 0x09-0x0D. Texts come as UTF-8 bytes.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 22
_U = np.uint64
MULTIPLIER = _U(0x9E3779B97F4A7C15)
_random = np.random.Generator(np.random.PCG64(20240101))
_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_VALUES[SPACE] = 0
_LOWERED = _VALUES.copy()
_LOWERED[65:91] = _VALUES[97:123]
#: letters and digits make words here, A-Z as a-z; any other byte below 0x80 parts them
_LETTERS = _LOWERED.copy()
_LETTERS[[i for i in range(128) if not chr(i).isalnum()]] = 0
_BASE = 0xD6E8FEB86659FD93
_POWERS = np.cumprod(np.full(1 << 16, _BASE, np.uint64), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def spans(raw: np.ndarray, values: np.ndarray = _VALUES) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of every word."""
    padded = np.ones(len(raw) + 2, np.int8)
    padded[1:-1] = (values == 0)[raw]
    edges = np.flatnonzero(np.diff(padded))
    return edges[::2], edges[1::2]


def _chunk_hashes(text: bytes, values: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    starts, _ = spans(raw, values)
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = starts[0]
    origin = np.repeat(starts, np.diff(np.append(starts, len(raw))))
    offset = (np.arange(first, len(raw)) - origin) & 0xFFFF
    return mix(np.add.reduceat(values[raw[first:]] * _POWERS[offset], starts - first))


def pieces(text: bytes):
    """A long text cut at white space into parts of about CHUNK bytes; a word is never cut."""
    begin = 0
    while len(text) - begin > CHUNK:
        end = begin + CHUNK
        while end < len(text) and not SPACE[text[end]]:
            end += 1
        yield text[begin:end]
        begin = end
    yield text[begin:]


def word_hashes(text: bytes | None, lower: bool) -> np.ndarray:
    """A hash of each word in order; ``lower`` treats A-Z as a-z. Null and empty have none."""
    if not text:
        return np.zeros(0, np.uint64)
    values = _LOWERED if lower else _VALUES
    if len(text) <= CHUNK:
        return _chunk_hashes(text, values)
    return np.concatenate([_chunk_hashes(part, values) for part in pieces(text)])


def letter_words(text: bytes | None) -> np.ndarray:
    """As :func:`word_hashes`, of runs of letters and digits, A-Z as a-z."""
    if not text:
        return np.zeros(0, np.uint64)
    return np.concatenate([_chunk_hashes(part, _LETTERS) for part in pieces(text)])


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; of all words if there are fewer; none without words."""
    size = min(size, len(words))
    if not size:
        return words[:0]
    n = len(words) - size + 1
    out = words[:n].copy()
    for k in range(1, size):
        out = out * MULTIPLIER + words[k:n + k]
    return mix(out + _U(size))


class MinHash:
    """Signatures of hash sets, and band keys made from them."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        random = np.random.Generator(np.random.PCG64(7))
        self.a = random.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = random.integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        high = (hashes >> _U(32)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for k in range(0, len(high), 2048):
            part = high[k:k + 2048, None] * self.a + self.b
            least = np.minimum(least, part.min(0))
        return least

    def keys(self, signature: np.ndarray) -> np.ndarray:
        rows = signature.reshape(self.bands, self.rows).astype(np.uint64)
        key = np.arange(self.bands, dtype=np.uint64)
        for k in range(self.rows):
            key = mix(key * MULTIPLIER + rows[:, k])
        return key.view(np.int64)


def set_hash(sorted_set: np.ndarray) -> int:
    """One 64-bit number for a sorted set of hashes."""
    place = np.arange(1, len(sorted_set) + 1, dtype=np.uint64) * MULTIPLIER
    total = mix(mix(sorted_set ^ place)).sum(dtype=np.uint64)
    return int(mix(np.array([total + _U(len(sorted_set))], np.uint64)).view(np.int64)[0])
