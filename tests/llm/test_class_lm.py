import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from samples import edge_rows, no_rows

from kurzwerk.llm import class_lm as L

SMALL = L.Settings(item_words=200, types=32, classes=8, sweeps=2, near_words=400)


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [""]


def test_counts_and_base_equal_brute_force_and_held_out_text_gains(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    c = collections.Counter(w for d, t in rows if not out(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in L.score(docs, SMALL).collect()}
    for d, text in rows:
        t, r = tokens(text), got[d]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (out(d), len(t), n)
        assert r.n_known == sum(c[w] > 0 for w in t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    default = {r.doc_id: r for r in L.score(docs).collect()}
    assert sum(default[r.doc_id].score for r in held) > sum(r.base_score for r in held)


def test_exchange_never_lowers_the_likelihood_of_fixed_contexts():
    r = np.random.default_rng(0)
    items, k = 60, 6
    group = np.arange(items) % 2
    text = [0]
    for _ in range(20_000):
        text.append(int(r.choice(np.flatnonzero(group != group[text[-1]]))))
    a, b = np.array(text[:-1]), np.array(text[1:])
    classes = np.concatenate([[0], 1 + np.arange(items - 1) // 2 % (k - 1)])

    def tables(classes):
        left, right = np.zeros((items, k)), np.zeros((items, k))
        np.add.at(left, (b, classes[a]), 1)
        np.add.at(right, (a, classes[b]), 1)
        return left, right

    def likelihood(classes):
        pairs = np.zeros((k, k))
        np.add.at(pairs, (classes[a], classes[b]), 1)
        return L.xlogx(pairs).sum() - L.xlogx(pairs.sum(0)).sum() - L.xlogx(pairs.sum(1)).sum()

    before = likelihood(classes)
    for _ in range(4):
        classes = L.exchange(classes, *tables(classes))
    assert likelihood(classes) > before and classes[0] == 0


def test_probabilities_of_what_may_follow_add_up_to_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text", L.held_out(docs.doc_id).alias("held_out"))
    counts = L.word_counts(rows.filter("not held_out"))
    v = L.vocabulary_of(counts, SMALL)
    model = L.fit(L.as_items(rows, v), v)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    for c in np.unique(model.classes):
        assert math.isclose((10 ** model.emission[model.classes == c]).sum(), 1, rel_tol=1e-6)
    by_type = collections.defaultdict(list)
    for r in counts.collect():
        word = bytes(r.word)
        if word and v.rank.get(word, v.n_own) >= v.n_own:
            by_type[L.type_of(word, SMALL.types)].append(r.n)
    for kind, held in by_type.items():
        total = (10 ** v.within_type(np.full(len(held) + 1, kind), np.array([*held, 0]))).sum()
        assert math.isclose(total, 1, rel_tol=1e-9)


def plain_scores(rows, s):
    """The model's log10 probabilities by plain counting, one token at a time."""
    train = [tokens(t) for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    c = collections.Counter(w for t in train for w in t)
    own = sorted((w for w in c if w), key=lambda w: (-c[w], w))[: s.item_words]
    item = {"": 0} | {w: k for k, w in enumerate(own, 1)}
    kind = lambda w: L.type_of(w.encode(), s.types)
    of = lambda w: item[w] if w in item else 1 + s.item_words + kind(w)
    n = 1 + s.item_words + s.types
    cls = [0] * n
    for w in own:
        cls[item[w]] = 1 + kind(w) % (s.classes - 1)
    for k in range(s.types):
        cls[1 + s.item_words + k] = 1 + k % (s.classes - 1)
    grams = collections.Counter()
    for t in train:
        ids = [0] + [of(w) for w in t]
        grams.update(zip(ids, ids[1:]))
    weight = collections.Counter()
    for (a, _), m in grams.items():
        weight[a] += m
    f = lambda x: x * math.log(x) if x > 0 else 0.0
    for _ in range(s.sweeps):
        known = list(cls)  # the neighbours' classes are those before the sweep
        order = sorted((w for w in range(1, n) if weight[w]), key=lambda w: -weight[w])
        for w in order:

            def likelihood(k):
                trial = cls[:w] + [k] + cls[w + 1 :]
                out, into, size = (collections.Counter() for _ in range(3))
                for (a, b), m in grams.items():
                    out[trial[a], known[b]] += m
                    into[known[a], trial[b]] += m
                for i, m in weight.items():
                    size[trial[i]] += m
                return sum(map(f, out.values())) + sum(map(f, into.values())) - 2 * sum(map(f, size.values()))

            found = [likelihood(k) for k in range(1, s.classes)]
            near = [k for k, x in enumerate(found, 1) if x > max(found) - 1e-7]
            cls[w] = near[0]
    pairs = np.full((s.classes, s.classes), s.transition_floor)
    seen = np.full(n, s.emission_floor)
    for (a, b), m in grams.items():
        pairs[cls[a], cls[b]] += m
        seen[b] += m
    seen[0] = max(seen[0] - s.emission_floor, s.emission_floor)
    tokens_of, words_of = collections.Counter(), collections.Counter()
    for w, m in c.items():
        if w not in item:
            tokens_of[kind(w)] += m
            words_of[kind(w)] += 1
    scores = {}
    for d, text in rows:
        total, before = 0.0, 0
        for w in tokens(text):
            i = of(w)
            total += math.log10(pairs[cls[before], cls[i]] / pairs[cls[before]].sum())
            total += math.log10(seen[i] / sum(seen[j] for j in range(n) if cls[j] == cls[i]))
            if w not in item and tokens_of[kind(w)]:
                k = kind(w)
                mass = c[w] - s.discount if c[w] else max(s.discount * words_of[k], s.discount)
                total += math.log10(mass / tokens_of[k])
            before = i
        scores[d] = total
    return scores


def test_scores_equal_plain_counting(spark):
    r = np.random.default_rng(5)
    pool = [f"{a}{b}" for a in "the cat runs to a far hill".split() for b in ("", "s", "ing", "ed")]
    odds = 1.0 / np.arange(1, len(pool) + 1)
    rows = [
        (d, " ".join(r.choice(pool, int(r.integers(0, 14)), p=odds / odds.sum()))) for d in range(90)
    ]
    s = L.Settings(item_words=10, types=5, classes=4, sweeps=2, near_words=14)
    want = plain_scores(rows, s)
    got = L.score(spark.createDataFrame(rows, "doc_id bigint, text string"), s).collect()
    assert len(got) == len(rows)
    for x in got:
        assert math.isclose(x.score, want[x.doc_id], rel_tol=1e-9), x


def test_types_of_all_words_are_those_of_each():
    words = [b"", b"a", b"ab", b"abc", b"abcd", "größe".encode(), b"\xff\x00"]
    for part in (pa.array(words, pa.binary()), pa.array([b"zz", *words], pa.large_binary())[1:]):
        assert L.types_of(part, 2048).tolist() == [L.type_of(w, 2048) for w in words]
    assert L.types_of(pa.array([], pa.binary()), 7).tolist() == []


def test_sizes_of_the_model_are_not_cut():
    s = L.Settings()
    assert (s.item_words, s.types, s.classes, s.near_words) >= (6000, 2048, 48, 300_000)
    assert min(s.item_words - 6000, s.types - 2048, s.classes - 48, s.near_words - 300_000) >= 0


def test_edge_rows(spark):
    assert L.score(no_rows(spark), SMALL).collect() == []
    got = L.score(edge_rows(spark), SMALL).collect()
    assert len(got) == 6 and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    one = spark.createDataFrame([(d, "x y") for d in range(60)], "doc_id bigint, text string")
    only = one.filter(L.held_out(one.doc_id))
    got = L.score(only, SMALL).collect()
    assert got and all(r.n_known == 0 and r.train_tokens == 0 for r in got)
