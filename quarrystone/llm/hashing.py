"""Vectorised 64-bit hashes of words and shingles of a text given as UTF-8."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
PIECE = 1 << 18

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE + 1, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_cache: dict[int, np.ndarray] = {}


def powers(base: int) -> np.ndarray:
    if base not in _cache:
        _cache[base] = _powers(base)
    return _cache[base]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word, lower-cased (A to Z); words are what stands between the six ASCII white spaces."""
    found, at = [], 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):  # a piece ends at white space, if there is one
            cut = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut > at:
                end = cut
            else:
                return _long_words(text)
        found.append(_piece(np.frombuffer(text, np.uint8, end - at, at)))
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def _piece(data: np.ndarray) -> np.ndarray:
    blank = np.concatenate(([True], _BLANK[data], [True]))
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])
    ends = np.flatnonzero(~blank[:-1] & blank[1:])
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data] + np.uint64(1)) * powers(BASE)[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE)[starts] ^ (ends - starts).astype(np.uint64))


def _long_words(text: bytes) -> np.ndarray:
    """For texts with a word longer than a piece: the same hashes, word by word."""
    out = []
    for word in text.split():
        total, length = 0, len(word)
        for at in range(0, length, PIECE):
            part = np.frombuffer(word, np.uint8, min(PIECE, length - at), at)
            value = int(np.sum((_LOWER[part] + np.uint64(1)) * powers(BASE)[: len(part)]))
            total = (total + value * pow(BASE, at, 1 << 64)) % (1 << 64)
        out.append(total ^ length)
    return mix(np.array(out, np.uint64))


def shingles(text: bytes, width: int) -> np.ndarray:
    """The distinct shingles of ``width`` words, sorted; of fewer words, the whole sequence as one; of none, none."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(width, len(words))
    count = len(words) - width + 1
    value = np.full(count, width, np.uint64)
    for k in range(width):
        value = mix(value * np.uint64(BASE) ^ words[k : k + count])
    return np.unique(value)
