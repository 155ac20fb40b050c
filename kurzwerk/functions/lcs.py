"""Length of the longest common subsequence of two token lists."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict

#: Cost of a step of each form, in microseconds: a match of the sparse one, a row of the
#: other and each of its bits. Only the choice between two exact forms hangs on them.
MATCH, ROW, BIT = 0.2, 0.4, 0.00025


def by_bits(a: list, b: list) -> int:
    """Bit-parallel LCS (Hyyrö 2004): one big-integer row update per token of ``b``."""
    places: dict = defaultdict(int)
    for i, token in enumerate(a):
        places[token] |= 1 << i
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & places.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def by_matches(a: list, b: list) -> int:
    """Sparse LCS (Hunt and Szymanski 1977): one search per pair of equal tokens.

    ``ends[k]`` is the least place in ``a`` where a common subsequence of k + 1 tokens
    can end.
    """
    places: dict = defaultdict(list)
    for i in range(len(a) - 1, -1, -1):
        places[a[i]].append(i)
    ends: list[int] = []
    for token in b:
        for place in places.get(token, ()):
            k = bisect_left(ends, place)
            if k == len(ends):
                ends.append(place)
            else:
                ends[k] = place
    return len(ends)


def lcs_length(a: list, b: list) -> int:
    """By the form that takes less for this pair, by its counted number of matches.

    Long texts of many different words have few matches for their length, and there the
    bit rows would be long as well; texts of few words have many, and short tables.
    """
    if not a or not b:
        return 0
    if len(a) < 256:  # a row is one small number
        return by_bits(a, b)
    times = Counter(a)
    matches = sum(times[token] for token in b)
    if matches * MATCH < len(b) * (ROW + len(a) * BIT):
        return by_matches(a, b)
    return by_bits(a, b)
