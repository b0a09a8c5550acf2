"""Words of a text as 64-bit numbers, computed for whole texts at once with numpy.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return
(``[^\\x20\\x09-\\x0D]+``). These six bytes never occur inside a UTF-8 sequence, so bytes and code points agree.
All arithmetic is modulo 2**64; no result depends on the process, the partition or the batch.
"""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a time; a text is cut at the last white space before the limit, so memory stays bounded.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit over all bits."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def seeds(name: int, count: int) -> np.ndarray:
    """``count`` fixed pseudo-random 64-bit numbers, another series for each ``name``."""
    return mix(mix(np.arange(count, dtype=np.uint64)) + np.uint64(name))


_BYTE = seeds(1, 256)  # the value of each byte in a polynomial hash
_BASE = int(seeds(2, 1)[0]) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, count: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64, kept and grown by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) < count:
        steps = np.full(max(count, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:count]


def _prefix_sums(x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x) + 1, np.uint64)
    out[0] = 0
    np.cumsum(x, out=out[1:])
    return out


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word of ``data`` (uint8)."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _SPACE[data]
    turns = np.flatnonzero(gap[1:] != gap[:-1])
    return turns[0::2], turns[1::2]


def chunks(data: np.ndarray, limit: int = 0):
    """(offset, part) pieces of at most ``limit`` bytes that end at white space; a longer word stays whole."""
    limit, at = limit or CHUNK_BYTES, 0
    while at < len(data):
        end = min(at + limit, len(data))
        if end < len(data):
            inside = np.flatnonzero(_SPACE[data[at:end]])
            if len(inside):
                end = at + int(inside[-1]) + 1
            else:
                ahead = end
                while ahead < len(data) and not _SPACE[data[ahead : ahead + limit]].any():
                    ahead += limit
                after = np.flatnonzero(_SPACE[data[ahead : ahead + limit]])
                end = ahead + int(after[0]) + 1 if len(after) else len(data)
        yield at, data[at:end]
        at = end


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """The 64-bit hash of each word of ``text``, in order; ``lower`` folds A-Z first."""
    return hashed_words(text, lower)[0]


def hashed_words(text: str | None, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start byte and end byte of each word of the UTF-8 form of ``text`` (null: none)."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    found = []
    for offset, part in chunks(data):
        start, end = spans(part)
        codes = _BYTE[_LOWER[part] if lower else part]
        sums = _prefix_sums(codes * _powers(_BASE, len(part)))
        value = (sums[end] - sums[start]) * _powers(_INVERSE, len(part))[start]
        found.append((mix(value + (end - start).astype(np.uint64) * _GOLDEN), start + offset, end + offset))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """The 64-bit hash of every run of ``size`` consecutive words (none if there are fewer)."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    if size <= 8:
        powers, total = _powers(_BASE, size), np.zeros(len(words) - size + 1, np.uint64)
        for i in range(size):
            total += words[i : len(words) - size + 1 + i] * powers[i]
    else:
        sums = _prefix_sums(words * _powers(_BASE, len(words)))
        total = (sums[size:] - sums[:-size]) * _powers(_INVERSE, len(words))[: len(words) - size + 1]
    return mix(total + np.uint64(size))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct ``size``-word shingles; with fewer words the whole sequence is the only one."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(runs(words, min(size, len(words))))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
