import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import edge_rows, frame, no_rows, prose

from kurzwerk.llm import fill_middle as M

NO_RATES = M.Rates()


def brute(doc_id, text):
    """The contract, word by word, on a list of characters."""
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    points = list(text or "")
    n = len(points)
    if not points or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text or ""
    low, high = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    p, m, s = ("".join(points[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    if h[3] % 100 < 20:
        return n, "spm", low, high - low, "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", low, high - low, "<P>" + p + "<S>" + s + "<M>" + m


TEXTS = [
    None, "", "a", "é\n\r\n\x00 ", "😀" * 30, "has <P> inside", "<M>", "<S", "x<S<", ">P>",
    prose(1, 300), "é" * 40, *[prose(k, 12) for k in range(60)], "long " * 60_000,
]


def test_rows_equal_the_contract(spark):
    got = {r.doc_id: tuple(r)[1:] for r in M.fill_in_middle(frame(spark, TEXTS)).collect()}
    assert got == {i: brute(i, t) for i, t in enumerate(TEXTS)}
    assert {r[1] for r in got.values()} == {"plain", "psm", "spm"}


def test_digests_tell_output_and_restored_text(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in M.digests(frame(spark, TEXTS)).collect():
        assert r.output_sha256 == sha(brute(r.doc_id, TEXTS[r.doc_id])[4])
        assert r.restored_sha256 == sha(TEXTS[r.doc_id] or "")


@settings(max_examples=400, deadline=None)
@given(st.integers(-5, 10**12), st.text(alphabet="<>PSMa\né😀", max_size=40))
def test_any_text_comes_back(doc_id, text):
    n, form, a, m, output = M.transform(doc_id, text, M.CODE_POINT, NO_RATES)
    assert (n, form, a, m, output) == brute(doc_id, text)
    assert M.restore(output, form) == text


@pytest.mark.parametrize("unit, parts", [(r"\s*\S+\s*$|\s*\S+|\s+", str.split), (r"[^\n]*\n|[^\n]+", str.splitlines)])
def test_other_units_are_never_cut(unit, parts):
    text = "one two\nthree four five\nsix\n"
    for doc_id in range(80):
        n, form, a, m, output = M.transform(doc_id, text, unit, M.Rates(100, 50))
        assert n == len(parts(text)) and M.restore(output, form) == text
        for cut in (a, a + m):
            assert len(parts(text[:cut])) + len(parts(text[cut:])) == n


def test_rates_and_bad_units():
    assert all(M.transform(i, "abc", M.CODE_POINT, M.Rates(0))[1] == "plain" for i in range(50))
    assert all(M.transform(i, "abc", M.CODE_POINT, M.Rates(100, 100))[1] == "spm" for i in range(50))
    with pytest.raises(ValueError):
        M.transform(1, "a-b", "[a-z]", NO_RATES)
    with pytest.raises(ValueError):
        M.restore("no mark", "psm")


def test_edge_tables(spark):
    assert M.digests(no_rows(spark)).collect() == [] == M.fill_in_middle(no_rows(spark)).collect()
    rows = M.fill_in_middle(edge_rows(spark)).collect()
    assert len(rows) == 6
    assert [r.n for r in rows if r.doc_id in (1, 2)] == [0, 0]
    assert len({r.output for r in rows if r.doc_id == 3}) == 1
    null = next(r for r in rows if r.doc_id is None)
    assert M.restore(null.output, null.form) == "Null id here."
