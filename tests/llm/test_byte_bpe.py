import hashlib
import random

import pyarrow as pa
import pytest
from samples import edge_rows, frame, no_rows

from kurzwerk.llm import byte_bpe as B

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_multi_50k.tiktoken")
TOKENS = ["'s", "'S", "'re", "'ll", "'d", "'t", "'", "''", " ", "  ", "\n", "\t", "\r\n", "a", "bc", "Zé",
          "1", "23", "²", "½", "!", "?!", "…", "\xa0", " ", "\x1c", "\x85", "　", "漢字", "😀",
          "é", "​", "٣", "s", "lly", "<|endoftext|>", "thing"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=public.PATTERN, mergeable_ranks=B.ranks_of(PATH).rank, special_tokens={}
    )


def texts():
    r = random.Random(2)
    out = ["", " ", "it's", "it'sabc", " 's", "''s", "!'s", "\n's", "'ll'", "'s's", "ab" * 400, "x" * 3000]
    out += ["".join(r.choice(TOKENS) for _ in range(r.randint(0, 25))) for _ in range(2500)]
    points = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    return out + ["a".join(points[k : k + 2000]) for k in range(0, len(points), 2000)]


def test_equals_the_library_and_decodes_back(library):
    k, rows = 0, texts()
    for ids, at, told in B.encode_texts(pa.array(rows), PATH):
        back = B.ranks_of(PATH).decode(ids, at).to_pylist()
        for i, (a, b) in enumerate(zip(at, at[1:])):
            want = library.encode_ordinary(rows[k])
            assert ids[a:b].tolist() == want
            assert told[i].as_py() == ",".join(map(str, want)) and back[i] == rows[k].encode()
            k += 1
    assert k == len(rows)


def test_frames(spark, library):
    assert B.digests(no_rows(spark), PATH).collect() == []
    assert len(B.digests(edge_rows(spark), PATH).collect()) == 6
    rows = ["One thing, it's 2 o'clock.", None, "long " * 100_000]
    df = frame(spark, rows)
    for r in B.digests(df, PATH).collect():
        ids = library.encode_ordinary(rows[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((rows[r.doc_id] or "").encode()).hexdigest()
    back = B.decode(B.encode(df, PATH), PATH).collect()
    assert {r.doc_id: bytes(r.content).decode() for r in back} == {i: t or "" for i, t in enumerate(rows)}


def test_long_batches_are_coded_in_small_steps(monkeypatch):
    steps, at_once = [], B.Ranks.encode_slice
    monkeypatch.setattr(B.Ranks, "encode_slice", lambda r, data, at: steps.append(len(data)) or at_once(r, data, at))
    list(B.encode_texts(pa.array(["a few words " * 100] * 4000), PATH))
    assert sum(steps) == 1200 * 4000 and max(steps) <= 1 << 19
