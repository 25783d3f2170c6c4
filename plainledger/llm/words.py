"""Vectorised word spans and hashes of UTF-8 bytes, for use inside tasks.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. A word's hash is a
polynomial over a table of pseudo-random byte values, mixed with its length; the
hash of a run of words is a polynomial over their hashes. All arithmetic wraps at
64 bits, under which long words made of few letters in a certain order (Thue-Morse)
meet, so a word of more than LONG bytes is hashed by XXH3 instead. Two different words
share a hash with probability 2^-64; hashes of runs are no better than those of words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

CHUNK = 1 << 20
LONG = 32
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_OTHER_BASE = 0xA0761D6478BD642F


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the SplitMix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BYTE_BASE))


@lru_cache(maxsize=1)
def _blank() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return table


_power_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, at least n of each."""
    have = _power_tables.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        tables = []
        for b in (base, inverse):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        have = _power_tables[base] = (tables[0], tables[1])
    return have


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(_blank()[data], out=inside[1:-1].view(bool))
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _chunks(data: np.ndarray):
    """Cut a long text at blanks, so that memory does not grow with its length."""
    at = 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data):
            ahead = np.flatnonzero(_blank()[data[end:end + 4096]])
            if len(ahead):
                end += int(ahead[0])
                break
            end = min(len(data), end + 4096)
        yield data[at:end]
        at = end


def hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash per word of the text."""
    whole = np.frombuffer(text, dtype=np.uint8)
    parts = []
    for data in _chunks(whole):
        starts, ends = spans(data)
        if not len(starts):
            continue
        up, down = _powers(_BYTE_BASE, len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_byte_values()[data] * up[: len(data)], out=sums[1:])
        own = (sums[ends] - sums[starts]) * down[starts]
        found = mix(own + (ends - starts).astype(np.uint64))
        for k in np.flatnonzero(ends - starts > LONG).tolist():
            found[k] = xxhash.xxh3_64_intdigest(data[starts[k]:ends[k]])
        parts.append(found)
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def runs(words: np.ndarray, size: int, other: bool = False) -> np.ndarray:
    """Hash of each run of `size` consecutive words; `other` picks a second, independent hash."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    base = _OTHER_BASE if other else _WORD_BASE
    source = mix(words + np.uint64(base)) if other else words
    out = np.empty(n, dtype=np.uint64)
    for at in range(0, n, CHUNK):
        part = source[at: min(n, at + CHUNK) + size - 1]
        up, down = _powers(base, len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        count = len(part) - size + 1
        out[at: at + count] = (sums[size:] - sums[:count]) * down[:count]
    return mix(out)


def covered(hit: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in a run of `size` words whose first word is marked."""
    edges = np.zeros(n + 1, dtype=np.int32)
    at = np.flatnonzero(hit)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + size, -1)
    return np.cumsum(edges[:n]) > 0


def lowest(values: np.ndarray, size: int) -> np.ndarray:
    """Smallest value of each run of `size` neighbours, by doubling."""
    have, width = values, 1
    while width * 2 <= size:
        have = np.minimum(have[:-width], have[width:])
        width *= 2
    if width < size:
        shift = size - width
        have = np.minimum(have[:-shift], have[shift:])
    return have
