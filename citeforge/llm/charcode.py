"""Characters as 64 codes, and counts of character n-grams in numpy."""

from __future__ import annotations

import numpy as np

#: Code 0 is the boundary; 1 to 26 are a to z; other letters share the rest by code point.
N = 64
_MOST = 0x3000


def _codes() -> np.ndarray:
    table = np.zeros(_MOST + 1, np.uint8)
    for point in range(_MOST):
        c = chr(point)
        if c.isalpha():
            table[point] = ord(c) - 96 if "a" <= c <= "z" else 27 + point % 37
    table[_MOST] = 27  # further scripts are told apart by point % 37 in codes()
    return table


TABLE = _codes()


def codes(lowered: str) -> np.ndarray:
    """A code for each character; runs of non-letters are not yet merged."""
    points = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = TABLE[np.minimum(points, _MOST)]
    far = points >= _MOST
    if far.any():
        out[far] = [27 + p % 37 if chr(p).isalpha() else 0 for p in points[far].tolist()]
    return out


def merged(code: np.ndarray) -> np.ndarray:
    """Keeps one boundary of each run of boundaries."""
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    return code[keep]


def trigrams(code: np.ndarray) -> np.ndarray:
    """Index of each trigram that does not end in its first two places; code begins with a boundary."""
    c = code.astype(np.int32)
    return (c[:-2] << 12) | (c[1:-1] << 6) | c[2:]
