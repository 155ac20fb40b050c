import collections
import hashlib
import random

import pytest
from samples import broadcasts, edge_rows, frame, no_rows

from kurzwerk.llm import suffix_dedup as S


def brute(docs, length):
    texts = [(d, (t or "").encode()) for d, t in docs]
    starts = collections.Counter(
        b[i : i + length] for _, b in texts for i in range(len(b) - length + 1)
    )
    rows = []
    for d, b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(x and not (i and gone[i - 1]) for i, x in enumerate(gone))
        kept = bytes(x for x, y in zip(b, gone) if not y)
        rows.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(rows, key=str)


def sample_docs():
    r = random.Random(5)
    piece = lambda n: "".join(r.choice("abcdefghé \n") for _ in range(n))
    shared = [piece(r.randint(60, 300)) for _ in range(5)]
    docs = [(0, None), (1, ""), (2, "a" * 900), (3, "ab" * 400), (None, piece(450))]
    for i in range(40):
        parts = [r.choice(shared) if r.random() < 0.6 else piece(r.randint(0, 90)) for _ in range(r.randint(0, 9))]
        docs.append((i + 10, "".join(parts)))
    return docs + docs[20:23] + [(7, docs[30][1])]


@pytest.mark.parametrize("length", [65, 150, 400])
def test_equals_brute_force(spark, length):
    docs = sample_docs()
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in S.remove_repeats(df, length).collect()), key=str)
    assert got == brute(docs, length)


def test_shuffled_lists_and_cut_texts_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_ENTRIES", -1)
    docs = sample_docs()
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in S.remove_repeats(df, 100).collect()), key=str)
    assert got == brute(docs, 100)


def test_long_texts_are_cut_into_pieces_without_loss(monkeypatch):
    import numpy as np

    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    offsets = np.array([0, len(data)])
    whole = S.samples_of(data, offsets, 200)
    windows = {(int(p), d) for p, a, b in zip(*whole[1:4]) for d in range(a, b + 1)}
    monkeypatch.setattr(S, "PIECE_BYTES", 700)
    cut = set()
    for base, part, at in S.pieces(data, offsets, 200):
        found = S.samples_of(part, at, 200)
        cut |= {(int(p) + base, d) for p, a, b in zip(*found[1:4]) for d in range(a, b + 1)}
    assert cut == windows and len(windows) == 5000 - 200 + 1


def test_edge_rows(spark):
    assert S.remove_repeats(no_rows(spark)).collect() == []
    rows = S.remove_repeats(edge_rows(spark)).collect()
    assert len(rows) == 6 and all(r.n_removed == 0 for r in rows)


@pytest.mark.parametrize("other", ["spans", "digest", "Digest", "place", "text_", "inner"])
def test_texts_without_their_repeats(spark, other):
    a, b = "ü" * 300 + " own text", "x" * 500
    docs = [(1, a, 309, "k"), (2, b, 500, "k"), (3, b, 500, "k"), (4, "short", 5, None), (5, None, 0, "n")]
    df = spark.createDataFrame(docs, f"doc_id bigint, text string, n_chars bigint, {other} string")
    out = S.without_repeats(df)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == df.columns
    assert set(got) == {1, 4} and got[4].text == "short" and got[1][other] == "k"
    assert got[1].n_chars == len(got[1].text) and got[1].text.endswith(" own text")


def test_no_texts_without_repeats(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, digest string")
    assert S.without_repeats(df).collect() == []


def test_large_lists_are_not_broadcast(spark, tmp_path):
    texts = frame(spark, ["a", "b"]).selectExpr("text AS digest", "text")
    texts.selectExpr("digest", "sequence(1, 300000) AS spans").write.parquet(str(tmp_path / "lists"))
    lists = spark.read.parquet(str(tmp_path / "lists"))
    for entries, few in ((500_000, True), (600_000, False)):
        joined = S.joined_to_texts(texts, lists, entries, "left")
        assert broadcasts(joined) == few and joined.filter("size(spans) = 300000").count() == 2
