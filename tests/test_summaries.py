import random
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from models import model_covered, model_summary
from pyspark.sql import functions as F

from kurzwerk.functions import text as X
from kurzwerk.operators import metrics as M
from kurzwerk.operators import summarize as S
from kurzwerk.operators.model_process import ModelError, ModelProcess
from kurzwerk.params import Params
from kurzwerk.plans import summarise as PS

RESULT = "doc_id long, chunk_no int, chunk string, summary string, model_name string, error string, elapsed double"


def merged(spark, rows):
    df = spark.createDataFrame(rows, RESULT)
    return {r.doc_id: r for r in M.document_record(M.merge_summaries(df)).collect()}


def random_chunks(n, seed=2):
    rng = random.Random(seed)
    pool = "der die das und Haus Baum läuft schnell 42 -- ...".split()

    def sentence():
        return " ".join(rng.choice(pool) for _ in range(rng.randint(1, 30))) + rng.choice([".", "!", " .", ""])

    return [" ".join(sentence() for _ in range(rng.randint(1, 12))).strip() for _ in range(n)] + ["...", ""]


def test_extractive_summary_equals_the_plain_model(spark):
    chunks = random_chunks(150)
    df = spark.createDataFrame([(i % 3, i, c) for i, c in enumerate(chunks)], "doc_id int, chunk_no int, chunk string")
    for most, least in ((40, 10), (150, 30), (5, 5)):
        got = S.summarize_chunks(df, max_tokens=most, min_tokens=least).collect()
        assert len(got) == len(chunks)
        for r in got:
            assert r.summary == model_summary(chunks[r.chunk_no], most, least), r.chunk_no


def test_hook_captures_errors_and_keeps_the_others(spark):
    def load():
        def model(texts):
            if any(t == "böse" for t in texts):
                raise RuntimeError("Modellfehler")
            return [f"kurz: {t}" for t in texts]

        return model

    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "böse"), (2, 0, "c")], "doc_id int, chunk_no int, chunk string")
    results = S.map_summarizer(df, load, "test-model")
    got = {(r.doc_id, r.chunk_no): r for r in results.collect()}
    assert got[1, 0].summary == "kurz: a" and got[1, 0].model_name == "test-model"
    assert got[1, 1].summary is None and "Modellfehler" in got[1, 1].error
    assert got[2, 0].elapsed >= 0
    docs = {r.doc_id: r for r in M.document_record(M.merge_summaries(results)).collect()}
    assert (docs[1].status, docs[1].summary) == ("failed", None)
    assert docs[1].message.startswith("⚠ ") and docs[2].status == "success"


def test_hook_refuses_a_wrong_number_of_summaries(spark):
    df = spark.createDataFrame([(1, 0, "a")], "doc_id int, chunk_no int, chunk string")
    row = S.map_summarizer(df, lambda: (lambda texts: []), "m").first()
    assert row.summary is None and "one summary per text" in row.error


def test_one_chunk(spark):
    got = merged(spark, [(1, 0, "Viele Worte über das Wetter.", "Es regnet.", "some-model", None, 1.0)])
    assert got[1].summary == "Es regnet."
    assert got[1].model_name == "some-model" and got[1].compression_rate > 0


def test_parts_are_joined_in_chunk_order(spark):
    got = merged(
        spark,
        [
            (1, 1, "Danach Sonne..", " dann B.\n", None, None, 0.25),
            (1, 0, "Zuerst Regen..", "erst A. ", "test-model", None, 0.5),
            (2, 0, "x", " ", None, None, 0.1),
            (2, 1, "x", "y", None, None, 0.1),
            (2, 2, "x", "", None, None, 0.1),
            (2, 3, "x", "z", None, None, 0.1),
        ],
    )
    assert got[1].summary == "erst A. dann B." and got[1].model_name == "test-model"
    assert (got[1].input_characters, got[1].summary_characters, got[1].n_chunks) == (28, 15, 2)
    assert got[1].processing_time_seconds == 0.75
    assert got[2].summary == "y  z" and got[2].model_name == "unknown"


def test_a_document_with_a_third_of_all_chunks(spark):
    hot = spark.range(5000).selectExpr("0L doc_id", "cast(id as int) chunk_no")
    rest = spark.range(10000).selectExpr("1 + id % 5000 doc_id", "cast(id div 5000 as int) chunk_no")
    df = hot.union(rest).selectExpr(
        "*", "concat('wort', chunk_no) chunk", "concat('wort', chunk_no) summary",
        "'m' model_name", "cast(null as string) error", "cast(null as double) elapsed",
    )
    record = M.document_record(M.merge_summaries(df))
    got = record.filter("doc_id = 0").first()
    assert got.summary == " ".join(f"wort{i}" for i in range(5000))
    assert (got.n_chunks, got.extractive_coverage) == (5000, 1.0)
    assert record.filter("doc_id > 0 and summary = 'wort0 wort1'").count() == 5000


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("a b ab ba abc c".split())), st.lists(st.sampled_from("a b ab ba bc ca c d".split())))
def test_runs_do_not_change_the_covered_count(source, summary):
    """The per-word test used in Spark equals the greedy run measure."""
    joined = " ".join(source)
    assert model_covered(" ".join(source), " ".join(summary))[0] == sum(w in joined for w in summary)


def test_coverage_equals_the_greedy_model(spark):
    rng = random.Random(8)
    pool = "art party Haus haus bau baum um 42 x".split()
    pairs = [
        (" ".join(rng.choices(pool, k=rng.randint(0, 12))), " ".join(rng.choices(pool + ["rt", "zz"], k=rng.randint(0, 9))))
        for _ in range(500)
    ]
    df = spark.createDataFrame(pairs, "source string, summary string").select(
        F.array_distinct(X.word_tokens(F.col("source"))).alias("v"), X.word_tokens(F.col("summary")).alias("w")
    )
    got = df.select(
        M.covered_words(F.col("v"), F.col("w")).alias("c"), F.size("w").alias("n")
    ).withColumn("share", M.coverage(F.col("c"), F.col("n"))).collect()
    for (source, summary), r in zip(pairs, got):
        covered, n = model_covered(source, summary)
        assert (r.c, r.n) == (covered, n)
        assert r.share == (round(covered / n, 2) if n else 0.0)


def test_compression(spark):
    df = spark.createDataFrame([(1, 0), (0, 10), (1, 16), (253, 1000)], "s long, i long")
    got = [r[0] for r in df.select(M.compression_rate(F.col("s"), F.col("i"))).collect()]
    assert got == [0.0, 0.0, round(1 / 16, 3), 0.253]


def test_whole_way_is_row_local_and_skips_empty_texts(spark):
    chunks = random_chunks(60, seed=4)
    df = spark.createDataFrame(list(enumerate(chunks)), "doc_id long, text string")
    record = PS.summarise_documents(df, params=Params(max_tokens=30, overlap_tokens=5))
    got = record.collect()
    assert len(got) == len([c for c in chunks if c])
    plan = record._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Exchange", "Sort", "Join", "Window"))


def test_model_is_loaded_once_per_process_with_its_limits(spark):
    def load(max_tokens, min_tokens):
        import os

        tag = f"{os.getpid()}/{os.urandom(4).hex()}/{max_tokens}/{min_tokens}"
        return lambda texts: [tag for _ in texts]

    df = spark.range(60).selectExpr("id doc_id", "0 chunk_no", "concat('text ', id) chunk")
    got = S.map_summarizer(df, load, "m", tasks=12, params=Params(max_summary_tokens=7, min_summary_tokens=3))
    tags = {r.summary for r in got.collect()}
    assert len({t.split("/")[0] for t in tags}) == len(tags)
    assert all(t.endswith("/7/3") for t in tags)


def test_load_errors_empty_texts_and_cuts_are_told(spark):
    def broken():
        raise OSError("no weights")

    rows = [(1, 0, "a b c d"), (1, 1, ""), (2, 0, "a b")]
    df = spark.createDataFrame(rows, "doc_id int, chunk_no int, chunk string")
    got = S.map_summarizer(df, broken, "m").collect()
    assert all(r.summary is None for r in got)
    assert {"no weights" in r.error for r in got if r.chunk} == {True}
    seen = S.map_summarizer(df, lambda: (lambda texts: texts), "m", params=Params(model_input_tokens=5))
    by = {(r.doc_id, r.chunk_no): r for r in seen.collect()}
    assert (by[1, 0].summary, by[1, 0].truncated) == ("a b c", True)
    assert by[1, 1].error and not by[2, 0].truncated
    docs = {r.doc_id: r for r in M.document_record(M.merge_summaries(seen)).collect()}
    assert docs[1].error == by[1, 1].error and docs[1].truncated and not docs[2].truncated


def test_the_extractive_summary_has_no_input_limit(spark):
    text = "filler word. " * 2000 + "rare rare rare rare rare rare."
    df = spark.createDataFrame([(1, 0, text)], "doc_id int, chunk_no int, chunk string")
    got = S.summarize_chunks(df, max_tokens=6000, min_tokens=1).first()
    assert got.summary == text and got.elapsed >= 0


def hanging():
    def load(max_tokens):
        import os
        import time

        def model(texts):
            print("printed by a model")
            for t in texts:
                if "hang" in t:
                    time.sleep(3600)
                if "die" in t:
                    os._exit(3)
                if "bad" in t:
                    raise ValueError("refused")
            return [f"{max_tokens} {t}" for t in texts]

        return model

    return load


def test_a_model_that_hangs_on_one_text_fails_that_chunk_only(spark):
    texts = [f"text {i}" for i in range(20)]
    texts[3], texts[11], texts[17] = "hang here", "die here", "bad one"
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, chunk string").coalesce(1)
    params = Params(model_seconds=1.5, max_summary_tokens=9)
    started = time.perf_counter()
    rows = S.map_summarizer(df, hanging(), "m", ["doc_id"], tasks=1, params=params).collect()
    assert time.perf_counter() - started < 60
    by = {r.doc_id: r for r in rows}
    assert {i for i, r in by.items() if r.error} == {3, 11, 17} and len(by) == 20
    assert "no answer within 1.5 s" in by[3].error and by[3].elapsed >= 1.5
    assert "exit code 3" in by[11].error and by[17].error.endswith("ValueError: refused")
    assert all(r.summary == f"9 {texts[i]}" for i, r in by.items() if not r.error)


def test_a_child_is_replaced_and_ended():
    model = ModelProcess(hanging(), {"max_tokens": 1}, 1.0)
    first = model.child
    assert model(["a" * 3_000_000]) == ["1 " + "a" * 3_000_000] and model([]) == []
    with pytest.raises(ModelError, match="TimeoutError"):
        model(["hang"])
    assert first.returncode == -9 and model.child is None
    assert model(["b"]) == ["1 b"] and model.child.pid != first.pid
    second = model.child
    model.close()
    assert second.returncode is not None
    with pytest.raises(ModelError, match="KeyError"):
        ModelProcess(lambda: {}["weights"], {}, 1.0)


def test_time_limit_of_a_deployment_and_none():
    assert Params().model_seconds == 180
    assert Params.from_env({"ML_SERVICE_TIMEOUT": "7"}).model_seconds == 7


def test_without_a_limit_the_model_stays_in_its_worker(spark):
    def load():
        import sys

        return lambda texts: [sys.argv[0] for _ in texts]

    df = spark.createDataFrame([(1, "x")], "doc_id int, chunk string")
    for seconds in (None, 60):
        params = Params(model_seconds=seconds)
        place = S.map_summarizer(df, load, "m", ["doc_id"], params=params).first().summary
        assert (place == "-c") == (seconds is not None)


def test_sentences_are_ranked_in_runs_of_bounded_size(monkeypatch):
    rng = random.Random(5)

    def chunk():
        return [rng.choices("abcdefgh", k=rng.randint(0, 9)) for _ in range(rng.randint(0, 6))]

    rows = [[chunk() for _ in range(rng.randint(0, 3))] for _ in range(200)] + [[[["x"] * 700, ["y"]]]]
    lists = pa.array(rows, pa.list_(pa.list_(pa.list_(pa.string()))))
    whole, seen, at_once = S.kept_sentences(lists, 8, 3), [], S.kept_sentences
    monkeypatch.setattr(S, "RANKED_WORDS", 100)
    monkeypatch.setattr(S, "kept_sentences", lambda part, *n: seen.append(part) or at_once(part, *n))
    for begin, end in ((0, 201), (7, 90), (0, 0)):
        part = lists.slice(begin, end - begin)
        assert S.kept_in_runs(part, 8, 3).to_pylist() == whole.to_pylist()[begin:end]
    words = [len(p.flatten().flatten().flatten()) for p in seen]
    assert max(words) == 701 and sorted(words)[-2] <= 100
