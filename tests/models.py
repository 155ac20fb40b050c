"""Small plain models the Spark operators are checked against."""

import re
from collections import Counter


def check_slices(counts, slices, limit, overlap):
    """What the slices of a sentence list must be, stated one property at a time."""
    fits = [k for k, n in enumerate(counts) if n <= limit]
    total = lambda ks: sum(counts[k] for k in ks)
    soft = [(a, b) for a, b, hard in slices if not hard]
    held = [[k for k in fits if a <= k < b] for a, b in soft]
    # Long sentences are slices of their own, each once and in order.
    hard = [(a, b) for a, b, h in slices if h]
    assert hard == [(k, k + 1) for k in range(len(counts)) if counts[k] > limit]
    # A slice stands behind everything that was complete before it was closed.
    places = [a + 0.5 if h else b for a, b, h in slices]
    assert places == sorted(places)
    # No sentence is lost, no slice is empty, and each brings something new unless it
    # only repeats an overlap behind a long sentence.
    assert sorted({k for ks in held for k in ks}) == fits
    assert all(held)
    for (_, b), ks, after in zip(soft, held, [*held[1:], None]):
        if after is None:
            assert ks[-1] == fits[-1]
            continue
        # Closed because the sentence at b no longer fitted.
        assert total(ks) + counts[b] > limit
        # The overlap is the longest tail within its bound.
        tail = [k for k in after if k < b]
        assert tail == (ks[len(ks) - len(tail):]) and total(tail) <= overlap
        assert len(tail) == len(ks) or total(ks[len(ks) - len(tail) - 1 :]) > overlap
    # Not closed earlier: every new sentence fitted when it came.
    for i, ks in enumerate(held):
        seen = soft[i - 1][1] if i else 0
        for j, k in enumerate(ks):
            if k > seen and j:
                assert total(ks[:j]) + counts[k] <= limit
    # A long sentence closes what stands before it.
    for k in range(len(counts)):
        before = [ks for (a, b), ks in zip(soft, held) if a <= k < b and ks[0] < k]
        if counts[k] > limit and before:
            assert k in [b for _, b in soft]


def words(text):
    return re.findall(r"\w+", text.lower())


def model_covered(source, summary):
    """Covered words: those inside of any run of words that the source holds.

    A table over all (start, end) pairs tells which runs are held.
    """
    joined, tokens = " ".join(words(source)), words(summary)
    n = len(tokens)
    held = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if " ".join(tokens[i:j]) in joined]
    return len({k for i, j in held for k in range(i, j)}), n


def model_summary(chunk, most, least):
    pieces = re.split(r"(?<=[.!?])\s+", chunk)
    frequency = Counter(words(chunk))
    scored = []
    for i, s in enumerate(pieces):
        w = words(s)
        if w:
            scored.append((-sum(frequency[x] for x in w) / len(w), i, len(w)))
    total, kept = 0, []
    for _, i, n in sorted(scored):
        total += n
        if total <= most or total - n < least:
            kept.append(i)
    text = " ".join(pieces[i] for i in sorted(kept))
    units = [u for u in text.split(" ") if u]
    return text if len(units) <= most else " ".join(units[:most])


def model_rouge(reference, candidate, n, prepare=lambda t: t):
    def grams(text):
        t = [prepare(x) for x in re.findall("[a-z0-9]+", text.lower())]
        return Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))

    r, c = grams(reference), grams(candidate)
    hits = sum((r & c).values())
    p = hits / max(sum(c.values()), 1)
    q = hits / max(sum(r.values()), 1)
    return 2 * p * q / (p + q) if p + q > 0 else 0.0


def model_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(before[j - 1] + 1 if x == y else max(before[j], row[-1]))
    return row[-1]
