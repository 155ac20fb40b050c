"""Small tables with the hard cases: nulls, empty, repeated and clashing columns."""

import random


def frame(spark, texts, start=0):
    """doc_id, text and columns whose names the operators use inside."""
    rows = [(i + start, t, -1, "x", 7) for i, t in enumerate(texts)]
    schema = "doc_id bigint, text string, n int, key string, row int"
    return spark.createDataFrame(rows, schema)


def edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "One two."), (3, "One two."), (None, "Null id here."), (5, " \n\t ")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def no_rows(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def prose(seed, n_words, words="alpha beta gamma delta epsilon zeta eta theta iota kappa".split()):
    r = random.Random(seed)
    return " ".join(r.choice(words) + str(r.randint(0, 999)) for _ in range(n_words))


def broadcasts(df):
    """Whether a plan has a join by keys that is broadcast, before it runs."""
    return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()
