import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from models import check_slices
from pyspark.sql import functions as F

from kurzwerk.functions import tokens
from kurzwerk.functions.tokens import Subwords
from kurzwerk.operators import chunking as C


def chunks_of(spark, texts, **limits):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [[] for _ in texts]
    for r in C.chunk_text(df, **limits).orderBy("doc_id", "chunk_no").collect():
        assert r.chunk_no == len(out[r.doc_id])
        out[r.doc_id].append(r.chunk)
    return out


def from_slices(sentences, slices, limit):
    out = []
    for a, b, hard in slices:
        if hard:
            u = sentences[a].split(" ")
            out += [" ".join(u[i : i + limit]) for i in range(0, len(u), limit)]
        else:
            out.append(" ".join(s for s in sentences[a:b] if len(s.split(" ")) <= limit))
    return out


@settings(max_examples=400, deadline=None)
@given(
    st.lists(st.integers(1, 14), min_size=1, max_size=30),
    st.integers(1, 12),
    st.integers(0, 12),
)
def test_slices_have_all_stated_properties(counts, limit, overlap):
    check_slices(counts, C.pack(counts, limit, overlap), limit, overlap)


def test_spark_chunks_are_the_checked_slices(spark):
    rng = random.Random(11)

    def sentence():
        return " ".join("ab"[: rng.randint(1, 2)] for _ in range(rng.choice([1, 3, 9, 60]))) + rng.choice(".!?")

    texts = [" ".join(sentence() for _ in range(rng.randint(1, 40))) for _ in range(120)]
    for limit, overlap in ((20, 5), (10, 0), (50, 30)):
        got = chunks_of(spark, texts, max_tokens=limit, overlap_tokens=overlap)
        for text, chunks in zip(texts, got):
            parts = re.split(r"(?<=[.!?])\s+", text)
            counts = [len(p.split(" ")) for p in parts]
            if sum(counts) <= limit:
                assert chunks == [text]
                continue
            slices = C.pack(counts, limit, overlap)
            check_slices(counts, slices, limit, overlap)
            assert chunks == from_slices(parts, slices, limit)


def test_short_text_is_its_own_chunk(spark):
    texts = ["Nur dies hier.", "  nicht beschnitten. ", ""]
    assert chunks_of(spark, texts, max_tokens=100) == [[t] for t in texts]


def test_long_text_is_split_within_bounds(spark):
    text = "Der Fluss steigt im Winter oft weit über seine flachen Ufer. " * 200
    (chunks,) = chunks_of(spark, [text], max_tokens=100, overlap_tokens=10)
    assert len(chunks) > 1
    # Units are whole words here, so the bound is in words: the limit and the overlap.
    assert max(len(c.split(" ")) for c in chunks) <= 110


def test_unpunctuated_text_gives_no_blank_chunks(spark):
    (chunks,) = chunks_of(spark, ["Wort " * 2000], max_tokens=50)
    assert len(chunks) == 40 and all(c.strip() for c in chunks)


def test_trailing_hard_sentence_repeats_the_overlap(spark):
    text = "a b. c. " + "x " * 7 + "y."
    (chunks,) = chunks_of(spark, [text], max_tokens=4, overlap_tokens=1)
    assert chunks == ["a b. c.", "x x x x", "x x x y.", "c."]


def test_counts(spark):
    df = spark.createDataFrame([(1, "a. b. c. d."), (2, "a.")], "doc_id long, text string")
    rows = C.chunk_counts(C.chunk_text(df, max_tokens=2, overlap_tokens=0)).collect()
    assert {(r.doc_id, r.n_chunks, r.input_characters) for r in rows} == {(1, 2, 10), (2, 1, 2)}


def test_subword_chunks_equal_brute_force(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(path)

    def ids(t):
        return tok.encode(t, add_special_tokens=False).ids

    texts = [
        "Heute regnet es. Morgen schneit es! Und dann?",
        "ein sehr langer satz ohne ende " * 8,
        "Kurz. " + "wort " * 60 + "ende. Danach kommt noch etwas. Schluss.",
        "A b.",
    ]
    limit, overlap = 20, 6
    got = chunks_of(spark, texts, max_tokens=limit, overlap_tokens=overlap, counter=Subwords(path))
    for text, chunks in zip(texts, got):
        if len(ids(text)) <= limit:
            assert chunks == [text]
            continue
        import re

        parts = re.split(r"(?<=[.!?])\s+", text)
        want = []
        for a, b, hard in C.pack([len(ids(p)) for p in parts], limit, overlap):
            if hard:
                i = ids(parts[a])
                want += [tok.decode(i[k : k + limit]).strip() for k in range(0, len(i), limit)]
            else:
                want.append(" ".join(p for p in parts[a:b] if len(ids(p)) <= limit).strip())
        assert chunks == [c for c in want if c]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    counted = df.select(Subwords(path).count(F.col("t"))).collect()
    assert [r[0] for r in counted] == [len(ids(t)) for t in texts]


def test_subword_chunks_hold_two_workers_per_task(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = C.chunk_arrays(docs, counter=Subwords("none.json"))._jdf.queryExecution().executedPlan()
    assert plan.toString().count("ArrowEvalPython") == 2


def test_a_tokenizer_gets_bounded_batches(monkeypatch):
    seen = []

    class Words:
        def encode_batch_fast(self, texts, add_special_tokens):
            seen.append(texts)
            return [t.split() for t in texts]

    monkeypatch.setattr(tokens, "load_tokenizer", lambda path: Words())
    texts = ["wort " * (k % 300) for k in range(3000)] + ["lang " * 100_000, None, "", "ende"]
    sizes = Subwords("some.json").sizes(pa.array(texts, pa.string()))
    assert sizes.to_pylist() == [len((t or "").split()) for t in texts]
    held = [sum(map(len, batch)) for batch in seen]
    assert len(held) > 5 and sorted(held)[-2] <= tokens.CODED_BYTES and max(held) == 500_000
