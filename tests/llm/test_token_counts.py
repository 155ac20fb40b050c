import random

import pyarrow as pa
import pytest
from samples import edge_rows, frame, no_rows

from kurzwerk.llm import token_counts as T

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("piece_bpe_32k.model")


def library(pieces, byte_fallback):
    model = tokenizers.models.Unigram(pieces, unk_id=0, byte_fallback=byte_fallback)
    out = tokenizers.Tokenizer(model)
    out.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return out


def random_texts(tokens, n):
    r = random.Random(3)
    return ["".join(r.choice(tokens) for _ in range(r.randint(0, 20))) for _ in range(n)]


TIES = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0),
        ("aba", -3.0), ("▁a", -2.0), ("bb", -1.5)]
TOKENS = ["a", "the", " ", "  ", "\n", "thing", "ing", "é", "漢", "😀", "▁", "<0x41>", "<s>", "1", ".", "\t"]


@pytest.mark.parametrize("which", ["ties", "bytes"])
def test_equals_the_library(which):
    pieces = TIES if which == "ties" else T.load_pieces(PATH)
    texts = random_texts(list("aabbxy \né▁") if which == "ties" else TOKENS, 1500)
    want = [len(library(pieces, which == "bytes").encode(t).ids) for t in texts[:1]]
    lib = library(pieces, which == "bytes")
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert T.row_counts(T.Counter(pieces), pa.array(texts)).tolist() == want


def test_rows(spark):
    assert T.token_counts(no_rows(spark), PATH).collect() == []
    got = T.token_counts(edge_rows(spark), PATH).collect()
    assert [r.n_tokens for r in got][:2] == [0, 0] and len(got) == 6
    long = "word " * 200_000
    n = T.token_counts(frame(spark, [long]), PATH).first().n_tokens
    assert n == len(library(T.load_pieces(PATH), True).encode(long).ids)
