import csv
import glob
import json
import random
import time
from collections import Counter

import golden
import numpy as np
import pyarrow as pa
import pytest
from models import model_lcs, model_rouge
from pyspark.sql import functions as F

from kurzwerk.functions import overlap as O
from kurzwerk.functions.lcs import by_bits, by_matches, lcs_length
from kurzwerk.checks.stems import stem_ctes
from kurzwerk.functions import stem as S
from kurzwerk.functions.stem import stem
from kurzwerk.operators import evaluation as E
from kurzwerk.operators import rouge as R
from kurzwerk.params import Params
from kurzwerk.plans import evaluate as PE
from kurzwerk.sources import corpus, reports


def golden_detail(spark):
    rows = [(i, *r) for i, r in enumerate(golden.DETAIL)]
    kinds = ["double"] * 5 + ["long"] * 2
    return spark.createDataFrame(rows, "example_id int, " + ", ".join(f"{n} {k}" for n, k in zip(E.DETAIL, kinds)))


def test_published_report(spark):
    assert E.evaluation_report(golden_detail(spark)).first().asDict() == golden.REPORT


def test_reports_are_written_side_by_side(spark, tmp_path):
    detail = golden_detail(spark)
    report = E.evaluation_report(detail, model_name="größe")
    for _ in range(2):
        reports.write_evaluation(detail, report, str(tmp_path / "results"))
    file = tmp_path / "results.json"
    raw = open(file, encoding="utf-8").read()
    assert "größe" in raw and json.loads(raw) == {**golden.REPORT, "model_name": "größe"}
    rows = [r for f in glob.glob(str(tmp_path / "results.csv" / "part-*")) for r in csv.DictReader(open(f))]
    assert len(rows) == 30 and list(rows[0]) == ["example_id", *E.DETAIL]
    again = reports.read_detail(spark, str(tmp_path / "results.csv"), detail.schema)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, detail.collect()))


def test_exact_quantile(spark):
    rng = random.Random(1)
    cases = [
        [rng.lognormvariate(0, 3) for _ in range(4000)],
        [0.0] * 3000 + [rng.random() for _ in range(2000)],
        [7.0],
        [1.0, 2.0],
        [5.0] * 100,
        [-rng.random() * 10 ** rng.randint(-9, 9) for _ in range(3000)],
        # Two clusters of many values with a wide gap between the wanted ranks.
        [rng.random() for _ in range(1000)] + [1e9 + rng.random() for _ in range(1000)],
    ]
    for values in cases:
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        for q in (0.95, 0.5, 0.0, 1.0):
            # Few buckets make the narrowing work even on small inputs.
            assert E.exact_quantile(df, "v", q, buckets=16) == np.quantile(values, q), (len(values), q)
    assert E.exact_quantile(spark.createDataFrame([(None,)], "v double"), "v", 0.5) is None


def test_rouge_equals_brute_force(spark):
    rng = random.Random(6)
    pool = "the cat sat on mats running quickly 42 é nationality".split()
    pairs = [
        (i, " ".join(rng.choices(pool, k=rng.randint(0, 15))), " ".join(rng.choices(pool, k=rng.randint(0, 15))))
        for i in range(300)
    ] + [(300, None, "the cat"), (301, "the cat", None), (302, None, None), (302, "a a a", "a a")]
    df = spark.createDataFrame(pairs, "pair_id int, reference string, candidate string")
    for stemmed in (False, True):
        prepare = stem if stemmed else (lambda t: t)
        rows = R.rouge_scores(df, orders=(1, 2, 3), stem=stemmed).collect()
        assert len(rows) == len(pairs)
        for row, (i, a, b) in zip(sorted(rows, key=lambda r: (r.pair_id, r.rouge1_overlap)), pairs):
            assert row.pair_id == i
            for n in (1, 2, 3):
                assert abs(row[f"rouge{n}_f"] - model_rouge(a or "", b or "", n, prepare)) < 1e-12
    assert (row.rouge1_overlap, row.rouge2_overlap, row.rouge2_reference, row.rougeL_overlap) == (2, 1, 2, 2)


def test_scores_are_row_local(spark):
    """No n-gram becomes a row: one Python step and nothing that moves or sorts."""
    rows = [(1, "a b", "a", 1, "x")]
    df = spark.createDataFrame(rows, "example_id int, article string, reference string, n int, error string")
    plan = PE.detail_of(df)._jdf.queryExecution().executedPlan().toString()
    for node in ("Exchange", "Aggregate", "Generate", "Sort", "Join", "Window"):
        assert node not in plan, node
    scores = R.rouge_scores(df, "example_id", "article", "reference", carry=["error"])
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_n_grams_of_many_words_stay_apart():
    """Numbers of grams are exact however many different tokens there are."""
    import pyarrow as pa

    rng = random.Random(2)
    texts = [[str(rng.randrange(50_000)) for _ in range(rng.randrange(400))] for _ in range(60)]
    other = [t[rng.randrange(5) :] + texts[(i * 7) % 60][:50] for i, t in enumerate(texts)]
    sides = O.coded([pa.array(texts), pa.array(other)], False)
    for n in (1, 2, 4):
        grams = lambda t: Counter(tuple(t[k : k + n]) for k in range(len(t) - n + 1))  # noqa: E731, B023
        want = [sum((grams(a) & grams(b)).values()) for a, b in zip(texts, other)]
        assert O.shared_grams(sides, n, 60).tolist() == want


def test_lcs_equals_the_table():
    rng = random.Random(9)
    for _ in range(400):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 40))]
        b = [rng.choice("abcde") for _ in range(rng.randint(0, 40))]
        assert by_bits(a, b) == by_matches(a, b) == lcs_length(a, b) == model_lcs(a, b)
    for pool in (3, 5000):
        a, b = ([rng.randrange(pool) for _ in range(600)] for _ in range(2))
        assert lcs_length(a, b) == model_lcs(a, b)


@pytest.mark.parametrize("pool", [20, 3_000, 10**9])
def test_lcs_of_long_texts_takes_seconds(pool):
    """Few words (many matches) and many words (wide tables) alike."""
    rng = random.Random(4)
    a = [rng.randrange(pool) for _ in range(50_000)]
    b = [x for x in a if rng.random() < 0.7] + [rng.randrange(pool) for _ in range(15_000)]
    started = time.perf_counter()
    assert lcs_length(a, b) >= 30_000
    assert time.perf_counter() - started < 10


def test_stems():
    # Examples of the published rules.
    pairs = {
        "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed",
        "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing",
        "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
        "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
        "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit",
        "rational": "ration", "valenci": "valenc", "digitizer": "digit", "operator": "oper",
        "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
        "formaliti": "formal", "sensitiviti": "sensit", "triplicate": "triplic",
        "formative": "form", "formalize": "formal", "electrical": "electr", "goodness": "good",
        "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
        "adjustable": "adjust", "replacement": "replac", "adoption": "adopt",
        "communism": "commun", "activate": "activ", "effective": "effect", "probate": "probat",
        "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
        "generalizations": "gener", "oscillators": "oscil", "dying": "die", "news": "news",
        "the": "the", "skies": "sky", "running": "run", "nationality": "nation",
    }
    assert {w: stem(w) for w in pairs} == pairs


def test_stems_equal_those_of_sql():
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(11)
    ends = (
        " s es ies ss sses ed eed ied ing ings at bl iz y ational tional enci anci izer bli alli "
        "entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti biliti fulli "
        "logi icate ative alize iciti ical ful ness al ance ence er ic able ible ant ement ment "
        "ent ion sion tion ou ism ate iti ous ive ize e ll lle yly"
    ).split(" ")
    words = set(S.IRREGULAR) | {"abcd", "12ed", "x", "", "toys"} - {""}
    for _ in range(40_000):
        root = "".join(rng.choice("aeiouybcdlnrstwxz1") for _ in range(rng.randint(1, 6)))
        words.add(root + "".join(rng.choices(ends, k=rng.randint(0, 2))))
    con = duckdb.connect()
    con.execute("CREATE TABLE vocabulary AS SELECT unnest(?::VARCHAR[]) AS word", [sorted(words)])
    got = dict(con.execute(f"WITH {stem_ctes('vocabulary')} SELECT word, w FROM stems").fetchall())
    assert got.keys() == words
    assert [(w, got[w], stem(w)) for w in sorted(words) if got[w] != stem(w)] == []


def example_rows(spark):
    rows = [(i, f"The cat number {i} sat. It ran away quickly. " * 3, "The cat sat.") for i in range(12)] + [(99, "", "x")]
    return spark.createDataFrame(rows, "example_id int, article string, reference string")


def test_evaluate_with_a_model(spark, tmp_path):
    df = example_rows(spark)

    def load(max_tokens):
        return lambda texts: [t[: max_tokens // 15] for t in texts]

    report = PE.evaluate(df, "cats", str(tmp_path / "r"), num_samples=5, load=load, model_name="m").first()
    assert (report.num_samples, report.n_failed, report.model_name, report.dataset) == (5, 0, "m", "cats")
    assert 0 < report.rouge1_f_mean <= 1 and report.processing_time_seconds_p95 is not None
    detail = {r.example_id: r for r in PE.detail_of(df).collect()}
    assert len(detail) == 13 and detail[99].compression_rate == 0.0


def test_the_default_is_named_timed_and_leaves_no_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(PE, "work_dir", lambda spark, purpose: str(tmp_path / purpose))
    report = PE.evaluate(example_rows(spark), "cats", str(tmp_path / "r")).first()
    assert (report.model_name, report.num_samples) == ("extractive-tf", 13)
    file = tmp_path / "r.json"
    written = json.loads(open(file, encoding="utf-8").read())
    assert set(golden.REPORT) < set(written) and written["processing_time_seconds_mean"] is not None
    assert sorted(f.name for f in tmp_path.iterdir()) == ["r.csv", "r.json"]


def test_failed_examples_are_never_scored_as_zero(spark):
    df = example_rows(spark).filter("example_id < 10")

    def load():
        def model(texts):
            if any("number 3" in t or "number 4" in t for t in texts):
                raise ValueError("no")
            return ["The cat sat." for _ in texts]

        return model

    with pytest.raises(PE.ExamplesFailed, match="2 of 10 .*ValueError: no"):
        PE.evaluate(df, "cats", load=load)
    report = PE.evaluate(df, "cats", load=load, allow_failed=True).first()
    assert (report.num_samples, report.n_failed, report.rouge1_f_mean) == (8, 2, 1.0)


def test_articles_are_read_whole_unless_asked(spark):
    text = "one two. " * 1000 + "three"
    df = spark.createDataFrame([(1, text, "three")], "example_id int, article string, reference string")

    def load():
        return lambda texts: [t[-5:] for t in texts]

    wide = Params(model_input_tokens=10_000)
    assert PE.examples_of(df, params=wide, load=load).first().generated == "three"
    cut = Params(model_input_tokens=10_000, eval_article_chars=4000)
    assert PE.examples_of(df, params=cut, load=load).first().generated == text[3995:4000]


def test_sample_is_the_first_rows_by_key(spark):
    df = spark.range(1000).orderBy(F.desc("id")).withColumn("text", F.lit("x"))
    top = corpus.sample(df, "id", 5)
    assert sorted(r.id for r in top.collect()) == [0, 1, 2, 3, 4]
    plan = top._jdf.queryExecution().executedPlan().toString()
    line = next(x for x in plan.splitlines() if "TakeOrderedAndProject" in x)
    assert "text" not in line


def test_sample_takes_exactly_so_many_rows_where_keys_repeat(spark):
    rows = [(None, "z"), (None, "y")] + [(i // 10, f"t{i}") for i in range(100)] + [(1, "t10")] * 3
    df = spark.createDataFrame(rows, "id int, text string").repartition(7)
    for n in (0, 1, 2, 5, 12, 17, 60, 1000):
        got = corpus.sample(df, "id", n).collect()
        assert len(got) == min(n, len(rows))
        want = sorted(-1 if r[0] is None else r[0] for r in rows)[:n]
        assert sorted(-1 if r.id is None else r.id for r in got) == want
        again = corpus.sample(df.repartition(3), "id", n).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert corpus.sample(df.limit(0), "id", 3).collect() == []


def test_report_is_one_object_and_is_replaced_whole(spark, tmp_path):
    one = spark.createDataFrame([("größe", None, 0.5)], "model_name string, note string, value double")
    path = tmp_path / "new" / "r.json"
    for value in (0.5, 0.25):
        reports.write_report(one.withColumn("value", F.lit(value)), str(path))
        text = path.read_text(encoding="utf-8")
        assert text == '{\n  "model_name": "größe",\n  "note": null,\n  "value": %s\n}' % value
    assert [f.name for f in path.parent.iterdir()] == ["r.json"]
    for wrong in (one.limit(0), one.unionAll(one)):
        with pytest.raises(ValueError, match="one row"):
            reports.write_report(wrong, str(path))
    assert reports.read_report(spark, str(path), one.schema).first().value == 0.25
    reports.write_detail(one, str(tmp_path / "old.json"))
    reports.write_report(one, str(tmp_path / "old.json"))
    assert (tmp_path / "old.json").is_file()


def test_pairs_are_counted_in_runs_of_bounded_size(monkeypatch):
    rng = random.Random(3)
    words = ["running", "runs", "flies", "fly", "a", "b", "c"]

    def column(n):
        rows = [rng.choices(words, k=rng.randint(0, 12)) if rng.random() < 0.9 else None for _ in range(n)]
        return pa.array([*rows, rng.choices(words, k=500)], pa.list_(pa.string()))

    sides, seen, at_once = (column(300), column(300)), [], O.run_columns
    whole = at_once(*sides, (1, 2), True, True)
    monkeypatch.setattr(O, "RUN_TOKENS", 64)
    monkeypatch.setattr(O, "run_columns", lambda a, b, *how: seen.append((a, b)) or at_once(a, b, *how))
    for begin, end in ((0, 301), (5, 77), (0, 0)):
        got = O.count_columns(*(side.slice(begin, end - begin) for side in sides), (1, 2), True, True)
        assert [c.tolist() for c in got] == [c[begin:end].tolist() for c in whole]
    tokens = [len(a.flatten()) + len(b.flatten()) for a, b in seen]
    assert max(tokens) == 1000 and sorted(tokens)[-2] <= 64


def test_the_memory_of_stems_is_small():
    assert stem.cache_info().maxsize <= 1 << 16
