import random
import re

import pyarrow as pa
from samples import edge_rows, frame, no_rows, prose

from kurzwerk.llm import quality as Q

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    words = re.findall(WORD, text or "")

    def covered(k):
        grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
        return {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(k)}

    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    out = {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(again),
        "n_repeat_words": len(covered(8)),
    }
    out["base_failed"] = len(words) < 20 or 100 * out["n_repeat_words"] > 30 * len(words)
    chars = max(out["word_chars"], 1)
    bad = any(sum(len(words[i]) for i in covered(k)) / chars > x for k, x in Q.NGRAM_LIMITS.items())
    bad |= sum(len("".join(re.findall(WORD, x))) for x in again) / chars > Q.LINE_CHARS_LIMIT
    bad |= len(again) > Q.LINES_LIMIT * len(lines)
    out["kept"] = not out["base_failed"] and not bad
    return out


def texts():
    r = random.Random(1)
    parts = ["a ", "b ", "é\n", "c|\t", " ", "\n", "ab\r\n", "#x "]
    out = [None, "", "\n", "a b\x1cc", prose(1, 60), prose(2, 60) + "\n" + prose(2, 12), "x\n" * 40]
    out += ["".join(r.choice(parts) for _ in range(r.randint(0, 90))) for _ in range(150)]
    return out + [prose(k, 40, ["a", "b", "c"]) for k in range(20)]


def test_equals_brute_force(spark):
    rows = texts()
    got = {r.doc_id: r.asDict() for r in Q.quality_rules(frame(spark, rows)).collect()}
    for i, text in enumerate(rows):
        want = brute(text)
        assert {k: got[i][k] for k in want} == want, text


def test_slices_do_not_matter(monkeypatch):
    rows = pa.array(texts())
    whole = Q.figures_of(rows, Q.NGRAM_LIMITS, (0.2, 0.3), 20)
    monkeypatch.setattr("kurzwerk.llm.quality.FINE_SLICE_BYTES", 64)
    cut = Q.figures_of(rows, Q.NGRAM_LIMITS, (0.2, 0.3), 20)
    assert all((whole[k] == cut[k]).all() for k in whole)


def test_rows_and_kept_documents(spark):
    assert Q.quality_rules(no_rows(spark)).collect() == []
    got = Q.quality_rules(edge_rows(spark)).collect()
    assert len(got) == 6 and not any(r.kept for r in got)
    df = frame(spark, [prose(1, 50), "few words", None, "word " * 100_000])
    kept = Q.kept_documents(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [0]
