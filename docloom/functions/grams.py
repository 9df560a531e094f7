"""Hashes of a text's character grams, for finding equal places without writing out every gram."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(text: str, size: int) -> np.ndarray:
    """64-bit hashes of the grams of ``size`` characters, one for each place (none: empty)."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    if len(codes) < size:
        return np.empty(0, np.uint64)
    # of lengths that double: out is the sum of codes by powers of the base over ``done`` characters
    out, done, power = np.zeros(len(codes) + 1, np.uint64), 0, codes
    width, base = 1, _BASE
    with np.errstate(over="ignore"):
        while True:
            if size & width:
                out = out[: len(codes) - done - width + 1] * base + power[done : done + len(codes) - done - width + 1]
                done += width
            if width << 1 > size:
                break
            power = power[:-width] * base + power[width:]
            width, base = width << 1, base * base
        out = (out ^ (out >> np.uint64(31))) * _MIX
        return out ^ (out >> np.uint64(29))


def least_in_windows(hashes: np.ndarray, window: int) -> np.ndarray:
    """The different least hashes of all runs of ``window`` hashes."""
    if len(hashes) < window:
        return np.empty(0, np.uint64)
    least, width = hashes, 1
    while width < window:
        step = min(width, window - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return np.unique(least)


def grams_of_all(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and hash of every gram of ``size`` characters of the texts, in one go."""
    n = np.array([len(t) for t in texts], np.int64)
    hashes = gram_hashes("".join(texts), size)
    if not len(hashes):
        return np.empty(0, np.int64), hashes
    ends = np.cumsum(n)
    row = np.repeat(np.arange(len(texts)), n)[: len(hashes)]
    inside = np.arange(len(hashes)) + size <= ends[row]
    return row[inside], hashes[inside]
