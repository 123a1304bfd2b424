"""Word hashes of whole texts, computed on numpy bytes.

A word hash is a polynomial over 64-bit letter values, taken from prefix
sums, so a batch of texts needs no loop over words.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["p"]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, base in (("p", _BASE), ("i", inverse)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["p"][:n], _POWERS["i"][:n]


def letters(separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(is a separator, value) per byte; A-Z have the values of a-z."""
    sep = np.zeros(256, bool)
    sep[list(separators)] = True
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    return sep, mix((lower + np.uint64(1)) * _BASE)


def word_spans(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of all words and the first word of each text (n + 1)."""
    word = ~sep[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = word[cuts]
    last[cuts - 1] = word[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text)."""
    starts, ends, at = word_spans(data, offsets, sep)
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * power[: len(data)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), at


def shingle_hashes(words: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text of fewer than ``size`` words, but not none, has its whole
    sequence as its one shingle; a text without words has none.
    """
    n = max(0, len(words) - size + 1)
    salts = mix(np.arange(1, size + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    all_ = np.zeros(n, np.uint64)
    for k in range(size):
        all_ += words[k : k + n] * salts[k]
    all_ = mix(all_)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(all_[a : b - size + 1]))
        elif b > a:
            own = words[a:b] * salts[: b - a]
            out.append(mix(np.add.reduce(own, dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
