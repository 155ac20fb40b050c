import collections
import random
import re

import numpy as np
from samples import broadcasts, edge_rows, frame, no_rows, prose

from kurzwerk.llm import near_dedup as N


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def brute(texts):
    """Smallest index of every text's class."""
    label = list(range(len(texts)))
    sets = [shingles(t) for t in texts]
    for i, a in enumerate(sets):
        for j in range(i):
            shared = sum((a & sets[j]).values())
            union = sum((a | sets[j]).values())
            if (not union) or shared >= 0.8 * union:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def varied(text, seed, changes):
    r = random.Random(seed)
    words = text.split(" ")
    for _ in range(changes):
        words[r.randrange(len(words))] = f"new{r.randint(0, 9999)}"
    return " ".join(words)


def corpus():
    texts = [prose(s, 40 + 10 * s) for s in range(12)]
    for s in range(4):
        texts += [varied(texts[s + 4], 10 * s + k, 1 + k) for k in range(6)]
    texts += [varied(texts[11], 100 + k, 1) for k in range(70)]
    texts += [texts[0], texts[0], "", None, "a b", "a  b", "same same same same same same"] * 2
    return texts


def test_classes_equal_brute_force(spark):
    texts = corpus()
    got = {r.doc_id: r.class_id for r in N.near_classes(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_large_buckets_and_shuffled_keys_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(N, "SMALL_BUCKET", 3)
    monkeypatch.setattr(N, "BROADCAST_KEYS", -1)
    texts = corpus()
    got = {r.doc_id: r.class_id for r in N.near_classes(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def family(pairs):
    """Texts of one template, any two 0.776 alike, in pairs that are 0.804 alike."""
    template = prose(1, 350)
    texts = []
    for k in range(pairs):
        shared = " ".join(f"pair{k}x{i}" for i in range(7))
        texts += [" ".join([template, shared, *(f"own{k}{s}{i}" for i in range(43))]) for s in "ab"]
    return texts


def test_pairs_within_a_large_family_that_is_not_alike(spark):
    texts = family(120)
    assert brute(texts[:8]) == [0, 0, 2, 2, 4, 4, 6, 6]
    got = {r.doc_id: r.class_id for r in N.near_classes(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [i - i % 2 for i in range(len(texts))]


def test_exact_pairs_hold_every_pair_that_is_alike(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(N, "HOT_UNIT", 3)
    texts = [varied(prose(7, 60 + k % 9), k, k % 4) for k in range(50)] + [prose(7, 75), prose(8, 5)]
    docs = frame(spark, texts).withColumn("digest", F.unhex(F.md5("text")))
    large = docs.select(F.lit(1).alias("key"), "digest", F.col("digest").alias("label"))
    ids = {bytes(r.digest): r.doc_id for r in docs.collect()}
    pairs = N.ordered(N.exact_pairs(large.distinct(), N.unit_sets(docs).dropDuplicates(["digest"]), 0.8)).collect()
    got = {frozenset((ids[bytes(r.a)], ids[bytes(r.b)])) for r in pairs}
    sets = {i: shingles(texts[i]) for i in ids.values()}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                assert frozenset((i, j)) in got


def test_signatures_agree_as_often_as_the_sets_are_alike():
    r = np.random.default_rng(0)
    darts, same = N.Darts(140), []
    for _ in range(30):
        u = r.integers(0, 2**63, 330).astype(np.uint64)
        a, b = u[:300], u[30:]
        s = darts.signatures(np.concatenate([a, b]), np.array([0, 300, 600]))
        same.append((s[0] == s[1]).mean())
    assert abs(np.mean(same) - 270 / 330) < 0.03


def test_sets_of_any_size_fill_their_signature():
    units = np.arange(1, 50_002, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    s = N.Darts(140).signatures(units, np.array([0, 1, 1, 50_001]))
    assert np.isfinite(s[[0, 2]]).all() and np.isinf(s[1]).all()


def test_edge_rows(spark):
    assert N.near_classes(no_rows(spark)).collect() == []
    got = sorted((r.doc_id or 0, r.class_id) for r in N.near_classes(edge_rows(spark)).collect())
    assert got == [(0, None), (1, 1), (2, 1), (3, 3), (3, 3), (5, 5)]


def test_one_of_each(spark):
    texts = corpus()
    kept = N.one_of_each(frame(spark, texts))
    assert kept.columns == ["doc_id", "text", "n", "key", "row"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute(texts)))
    assert N.one_of_each(edge_rows(spark)).count() == 4


def test_the_exact_join_holds_a_unit_once_per_text(spark, monkeypatch):
    from pyspark.sql import functions as F

    tables, store = {}, N.stored
    monkeypatch.setattr(N, "stored", lambda df, name: tables.setdefault(name, store(df, name)))
    docs = frame(spark, family(40)).withColumn("digest", F.unhex(F.md5("text")))
    large = docs.select(F.lit(1).alias("key"), "digest", F.col("digest").alias("label")).distinct()
    N.exact_pairs(large, N.unit_sets(docs).dropDuplicates(["digest"]), 0.8)
    held = tables["exact-prefixes"]
    assert 0 < held.count() == held.select("digest", "unit").distinct().count()


def test_units_of_one_label_stay_in_their_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    tables, store = {}, N.stored
    monkeypatch.setattr(N, "stored", lambda df, name: tables.setdefault(name, store(df, name)))
    docs = frame(spark, family(40)).withColumn("digest", F.unhex(F.md5("text")))
    large = docs.select(F.lit(1).alias("key"), "digest", F.col("digest").alias("label")).distinct()
    units = N.unit_sets(docs).dropDuplicates(["digest"])

    def held():
        tables.clear()
        pairs = N.ordered(N.exact_pairs(large, units, 0.8)).collect()
        rows = tables["exact-prefixes"].select("digest", "unit", "place", "n").collect()
        return set(pairs), sorted(rows), tables["exact-units"].count()

    pairs, rows, n = held()
    assert len(rows) <= n <= 1.2 * len(rows)
    # A map too small for the units lets more through and changes nothing else.
    monkeypatch.setattr(N, "BLOCK_BITS", 8)
    monkeypatch.setattr(N, "MOST_MARKS", 8)
    small = held()
    assert small[:2] == (pairs, rows) and small[2] > n


def test_a_text_meets_a_pivot_once_over_all_its_buckets(spark):
    rows = [(key, bytes([d]), bytes([d // 4])) for key in range(3) for d in range(12)]
    large = spark.createDataFrame(rows, "key bigint, digest binary, label binary")
    met = [(bytes(r.digest), bytes(r.other)) for r in N.pivot_pairs(large, 1).collect()]
    assert met and len(met) == len(set(met))
    assert all(a[0] // 4 != b[0] // 4 for a, b in met)


def test_many_keys_and_labels_are_not_broadcast(spark, tmp_path):
    from pyspark.sql import functions as F

    digest = F.unhex(F.md5(F.col("id").cast("string"))).alias("digest")
    for name, n in (("few", 100), ("many", 120_000)):
        spark.range(n).select(digest, digest.alias("label")).write.parquet(str(tmp_path / name))
    few, many = (spark.read.parquet(str(tmp_path / name)) for name in ("few", "many"))
    rows = spark.range(50).select(F.col("id").alias("key"), digest)
    for table in (few, many):
        kept = N.only(rows, table.select("digest"), "digest")
        told = N.with_labels(rows, table.withColumnRenamed("digest", "node"))
        assert broadcasts(kept) == broadcasts(told) == (table is few)
        assert kept.count() == told.filter("digest = label").count() == 50


def test_the_exact_join_is_broadcast_by_what_its_texts_ask_for(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = frame(spark, family(20)).withColumn("digest", F.unhex(F.md5("text")))
    large = docs.select(F.lit(1).alias("key"), "digest", F.col("digest").alias("label")).distinct()
    units = N.unit_sets(docs).dropDuplicates(["digest"])
    want = set(N.ordered(N.exact_pairs(large, units, 0.8)).collect())
    monkeypatch.setattr(N, "BROADCAST_KEYS", 10)
    pairs = N.exact_pairs(large, units, 0.8)
    assert not broadcasts(pairs)
    assert set(N.ordered(pairs).collect()) == want and len(want) >= 20


def test_one_of_each_with_shuffled_keys(spark, monkeypatch):
    docs = [frame(spark, corpus()), edge_rows(spark), edge_rows(spark).union(edge_rows(spark))]
    want = [sorted(map(str, N.one_of_each(d).select("doc_id", "text").collect())) for d in docs]
    monkeypatch.setattr(N, "BROADCAST_KEYS", -1)
    for d, rows in zip(docs, want):
        kept = N.one_of_each(d)
        assert kept.columns == d.columns and not broadcasts(kept)
        assert sorted(map(str, kept.select("doc_id", "text").collect())) == rows
