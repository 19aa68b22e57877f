"""Words of many texts at once: where they are and 64-bit hashes of them, by numpy, without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: An odd base of polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Characters that are worked on at once; a longer text is one piece of work by itself.
AT_ONCE = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grouped(texts: list[str | None], most: int = AT_ONCE) -> Iterator[slice]:
    """Slices of consecutive texts with at most `most` characters in all, one text at least."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > at and size + n > most:
            yield slice(at, i)
            at, size = i, 0
        size += n
    if at < len(texts):
        yield slice(at, len(texts))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true values."""
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of codes[start:end] for each pair, which come in order and don't overlap; equal runs have equal hashes."""
    out = np.empty(len(start), np.uint64)
    part = start // AT_ONCE if len(start) else start
    for p in np.unique(part):
        own = slice(*np.searchsorted(part, [p, p + 1]))
        low, high = int(start[own][0]), int(end[own][-1])
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((codes[low:high].astype(np.uint64) + np.uint64(1)) * powers(BASE, high - low), out=sums[1:])
        a, b = start[own] - low, end[own] - low
        out[own] = (sums[b] - sums[a]) * powers(INVERSE, high - low + 1)[a] + (b - a).astype(np.uint64)
    return mixed(out)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def per_text(start: np.ndarray, text_ends: np.ndarray) -> np.ndarray:
    """How many of the runs that begin at `start` belong to each text; text_ends are the places after each text."""
    return np.diff(np.searchsorted(start, text_ends, "left"), prepend=0)
