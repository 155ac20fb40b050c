import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from samples import frame, no_rows

from kurzwerk.llm import token_files as T
from kurzwerk.session import work_dir

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
ROWS = ["Once upon  a\ttime.", None, "", "É İ ß é 'S <|endoftext|> x\x1cy 　z", "a\n\nb", "tail " * 3000, "".join(map(chr, range(33, 3000)))]


def library(text):
    return tokenizers.Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library():
    assert [i.tolist() for i in T.word_ids(PATH).encode(pa.array(ROWS))] == [library(t) for t in ROWS]


def test_words_parted_before_signs_and_blanks_give_the_library_ids():
    rows = ["Été,l'été's 3.5%%% don't. (x)*** É×,a÷. <|endoftext|>,", " A  B\n\nC. D", "Σ.a a.Σ ΑΣ, x_y e\u0301. a\u0301,b 7\u0301.",
            "it's'S 'll. a'.s 'store a<b>c|d ñ!?", "3,4a5.b", "x\u00a0.y\u2014.z", " ", ".", "A"]
    assert [i.tolist() for i in T.WordIds(PATH).encode(pa.array(rows))] == [library(t) for t in rows]


def test_a_full_memory_drops_words_that_did_not_come_again(monkeypatch):
    monkeypatch.setattr(T, "CACHE_WORDS", 60)
    words = T.WordIds(PATH)
    for k in range(0, 300, 20):
        rows = [" ".join(["often", *(f"w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(k, k + 20))]), None]
        assert [i.tolist() for i in words.encode(pa.array(rows))] == [library(t) for t in rows]
        assert len(words.number) <= 60
    rows = [" ".join(f"x{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(200))]
    assert [i.tolist() for i in words.encode(pa.array(rows))] == [library(t) for t in rows]


def test_files_hold_ascending_documents(spark):
    docs = frame(spark, ROWS).union(frame(spark, ["null id"]).selectExpr("null", "text", "n", "key", "row"))
    got = T.roundtrip(spark, docs.repartition(3), PATH).collect()
    by = {r.doc_id: r for r in got}
    start = 0
    for doc_id, text in [(None, "null id"), *enumerate(ROWS)]:
        ids = [*library(text), 2]
        assert (by[doc_id].start, by[doc_id].n_tokens) == (start, len(ids))
        assert by[doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert len(got) == len(by)
    assert T.roundtrip(spark, no_rows(spark), PATH).collect() == []


def test_records_by_number_and_file_sizes(spark):
    place = work_dir(spark, "records")
    files = T.placed(T.write_token_files(frame(spark, ROWS).coalesce(1), PATH, place, 2, 100)).collect()
    assert sum(f.n_records for f in files) == len(ROWS) and len(files) > 1
    number = 0
    for f in sorted(files, key=lambda f: (f.part, f.file_no)):
        for k in range(f.n_records):
            doc_id, ids = T.record_at(f.file, k)
            assert doc_id == number and ids.tolist() == [*library(ROWS[number]), 2]
            number += 1


@pytest.mark.parametrize("at", [0, 9, 14, -1])
def test_damage_is_seen(at):
    raw = bytearray(T.frame(T.body_of(7, np.array([1, 70_000, 3], np.uint32))))
    assert T.parse_body(T.read_frame(io.BytesIO(bytes(raw))))[1].tolist() == [1, 70_000, 3]
    raw[at] ^= 1
    with pytest.raises(ValueError):
        T.read_frame(io.BytesIO(bytes(raw)))
    with pytest.raises(ValueError):
        T.read_frame(io.BytesIO(bytes(raw[:-3])))
