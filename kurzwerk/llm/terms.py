"""Terms of texts in byte arrays: runs of letters, digits and all beyond ASCII, in lower case."""

from __future__ import annotations

import numpy as np

#: What each byte becomes: A-Z in lower case, letters, digits and bytes beyond ASCII as
#: they are, all others 0.
FOLD = np.zeros(256, np.uint8)
for _low, _high, _shift in ((0x30, 0x39, 0), (0x41, 0x5A, 32), (0x61, 0x7A, 0), (0x80, 0xFF, 0)):
    FOLD[_low : _high + 1] = np.arange(_low, _high + 1) + _shift


def folded_terms(data: np.ndarray, offsets: np.ndarray):
    """(folded bytes, start and end of every term, first term of every row and the end)."""
    folded = FOLD[data]
    n = len(data)
    held = np.zeros(n + 2, bool)
    held[1:-1] = folded != 0
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(held[1:] & (~held[:-1] | edge))
    ends = np.flatnonzero(held[:-1] & (~held[1:] | edge))
    return folded, starts, ends, np.searchsorted(starts, offsets)
