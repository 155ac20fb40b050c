import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from samples import edge_rows, frame, no_rows, prose

from kurzwerk.llm import lexical_search as L

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(TERM, lower)


def brute(docs, items, k):
    """Every document scored for every item, as the contract says."""
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // total
            score = 0
            for t in set(terms(text)):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1000000000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, d is None, d))
        for rank, (score, _, d) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, d, -score))
    return out


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7)) % 400}" for _ in range(3000)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(n)]
    return texts + texts[: n // 10] + ["", None, "é W1 w1,w2-É", "....", "w1 " * 5000]


@pytest.mark.parametrize("stride, docs, share", [(2048, 8192, 1 / 16), (16, 40, 1 / 4), (7, 90, 0.0), (64, 64, 1.0)])
def test_equals_scoring_of_every_document(monkeypatch, stride, docs, share):
    monkeypatch.setattr(L, "STRIDE", stride)
    monkeypatch.setattr(L, "SEGMENT_DOCS", docs)
    monkeypatch.setattr(L, "SHORT_SHARE", share)
    monkeypatch.setattr("kurzwerk.llm.common.SLICE_BYTES", 3000)
    rows = list(enumerate(corpus(stride, 400)))
    random.Random(1).shuffle(rows)
    items = [(i, t) for i, t in rows[:40]] + [(90, "w1 w2 w3 nowhere"), (91, "nowhere"), (92, None)]
    block = L.numbered([i for i, _ in items], [[t.encode() for t in dict.fromkeys(terms(x))] for _, x in items])
    batches = [
        pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], pa.int64()), pa.array([t for _, t in part], pa.string())], ["doc_id", "text"])
        for part in (rows[:150], rows[150:])
    ]
    segments = list(L.index_batches(iter(batches), block.terms))
    assert len(segments) == 1 or docs < 8192
    (counts,) = L.count_batches(iter(segments), len(block.terms))
    of = L.statistics(dict(zip(*counts.to_pydict().values())), len(block.terms))
    got = [
        (block.ids[r["item"]], r["place"], r["doc_id"], r["score"])
        for batch in L.search_batches(iter(segments), block, of, 10)
        for r in batch.to_pylist()
    ]
    assert sorted(got) == sorted(brute(rows, items, 10))


def test_long_lists_are_not_gone_through(monkeypatch):
    """A rare term with high bound leaves a frequent one to look-ups only."""
    rows = [(i, "often " * (1 + i % 3) + ("rare rare" if i % 500 == 0 else "x")) for i in range(8000)]
    block = L.numbered([0], [[b"often", b"rare"]])
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows]), pa.array([t for _, t in rows])], ["doc_id", "text"])
    segments = list(L.index_batches(iter([batch]), block.terms))
    (counts,) = L.count_batches(iter(segments), 2)
    of = L.statistics(dict(zip(*counts.to_pydict().values())), 2)
    seen = []
    add = L.Best.add
    monkeypatch.setattr(L.Best, "add", lambda self, s, d, n: (seen.append(len(s)), add(self, s, d, n)))
    list(L.search_batches(iter(segments), block, of, 5))
    assert sum(seen) <= 16


def test_tables_with_ties_nulls_and_repeated_rows(spark):
    rows = corpus(5, 60)
    docs = [(i, t) for i, t in enumerate(rows)] + [(None, "w1 w2 w3 only"), (3, "w1 w5"), (3, "w1 w5")]
    items = [(1, "w1 w2"), (1, "w1 w2"), (None, "W5 only"), (7, None), (8, ""), (9, prose(1, 20) + " w3")]
    d = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id bigint, text string, item_id string, rank int").repartition(3)
    i = spark.createDataFrame([(a, b, 2) for a, b in items], "item_id bigint, text string, doc_id int")
    order = lambda x: sorted(x, key=repr)
    want = order(brute(docs, items, 7))
    assert order(map(tuple, L.search(d, i, 7).collect())) == want
    assert order(map(tuple, L.search(d, i, 7, 2, 3).collect())) == want


def test_empty_tables_and_long_texts(spark):
    items = spark.createDataFrame([(1, "one two")], "item_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert L.search(no_rows(spark), items).collect() == []
    assert L.search(edge_rows(spark), none).collect() == []
    got = L.search(frame(spark, ["one " * 300_000, "two", "one"]), items).collect()
    want = brute([(0, "one " * 300_000), (1, "two"), (2, "one")], [(1, "one two")], 50)
    assert sorted(map(tuple, got)) == want
