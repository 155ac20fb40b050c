import random
import re

from pyspark.sql import functions as F

from kurzwerk.functions import text as X


def column(spark, values, *functions, type_="string"):
    exprs = [f(F.col("v")) for f in functions]
    df = spark.createDataFrame([(v,) for v in values], f"v {type_}")
    return [tuple(r) if len(r) > 1 else r[0] for r in df.select(*exprs).collect()]


def test_clean_text_literals(spark):
    raw = [
        "Der Wasser-\nstand fiel über Nacht.",
        "oben\n\nmitte   links\r\nunten",
        "Nord-\nSüd",
        "ge-\r\nteilt",
        "a\tb",
        "  \n ",
        "x-\n1",
        "über-\nöffnen",
    ]
    assert column(spark, raw, X.clean_text) == [
        "Der Wasserstand fiel über Nacht.",
        "oben mitte links unten",
        "Nord- Süd",
        "ge- teilt",
        "a\tb",
        "",
        "x- 1",
        "überöffnen",
    ]


def test_strip_and_split_follow_python_white_space(spark):
    rng = random.Random(5)
    pool = "ab.!? \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0  　é"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    got = column(spark, texts, X.strip, X.sentences)
    for t, (stripped, parts) in zip(texts, got):
        assert stripped == t.strip()
        assert parts == re.split(r"(?<=[.!?])\s+", t)


def test_strip_is_linear_on_long_runs(spark):
    long = "a" + " " * 400_000 + "b" + " " * 400_000
    assert column(spark, [long], X.strip)[0] == long.strip()


def test_word_tokens(spark):
    texts = ["Hello, World! 42_x", "Größe ÄÖÜ ß", "", "...", "l'été à Paris"]
    assert column(spark, texts, X.word_tokens) == [
        re.findall(r"\w+", t.lower()) for t in texts
    ]


def test_truncation_counts_the_marker_tokens(spark):
    texts = [" ".join(["w"] * n) for n in (1, 1021, 1022, 1023, 2000)]
    rows = column(spark, texts, X.truncate_units)
    assert [(len(r["text"].split(" ")), r["truncated"]) for r in rows] == [
        (1, False),
        (1021, False),
        (1022, True),
        (1022, True),
        (1022, True),
    ]


def test_char_counts_and_cuts_are_code_points(spark):
    assert column(spark, ["äöü😀"], X.n_chars, lambda v: X.truncate_chars(v, 2)) == [(4, "äö")]


def test_python_round(spark):
    rng = random.Random(3)
    values = [2.675, 0.125, 0.0125, 0.285, 0.0625, 1.005, 0.0, 1.0, 0.5]
    values += [rng.random() for _ in range(5000)]
    values += [rng.randint(0, 2000) / 2000 for _ in range(3000)]
    values += [rng.randint(0, 400) / rng.randint(1, 999) for _ in range(5000)]
    got = column(spark, values, *[lambda v, d=d: X.python_round(v, d) for d in (2, 3, 4)], type_="double")
    assert got == [tuple(round(v, d) for d in (2, 3, 4)) for v in values]


def test_percent_text(spark):
    shares = [i / 100 for i in range(101)]
    got = column(spark, shares + [None], X.percent_text, type_="double")
    assert got == [f"{x * 100:.0f} %" for x in shares] + [None]
