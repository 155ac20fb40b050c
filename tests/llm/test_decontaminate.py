import collections
import random
import re

from samples import broadcasts, edge_rows, frame, no_rows, prose

from kurzwerk.llm import decontaminate as D


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(docs, items):
    hits = set()
    for i, item in enumerate(items):
        m = len(words(item))
        c = collections.Counter(shingles(words(item)))
        for d, text in enumerate(docs):
            s = shingles(words(text))
            for t in range(max(1, len(words(text)) - m + 1)):
                x = collections.Counter(s[t : t + m - 4])
                if c and x and sum((x & c).values()) >= 0.8 * sum((x | c).values()):
                    hits.add((d, i))
    return hits


def data():
    r = random.Random(4)
    items = [prose(100 + k, r.randint(8, 60)) for k in range(12)] + ["too short here", None, "Echo echo " * 12]
    docs = [prose(200 + k, r.randint(0, 300)) for k in range(30)]
    for k in range(12):
        w = items[k].upper().split()
        for _ in range(k % 3):
            w[r.randrange(len(w))] = "other"
        docs.append(prose(300 + k, 50) + " " + "! ".join(w) + ", " + prose(400 + k, 20))
    docs += ["echo " * 100, items[3], " ".join(items[4].split()[:-2]), items[5] + " " + items[5], None, ""]
    return docs, items


def run(spark, docs, items, **kw):
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id bigint, text string")
    return D.contaminated(frame(spark, docs), bench, **kw)


def test_equals_brute_force(spark):
    docs, items = data()
    got = run(spark, docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)
    assert len(got) == len(brute(docs, items))


def test_moved_blocks_and_insertions_equal_brute_force(spark):
    items = [prose(500 + k, 60) for k in range(6)]
    docs = []
    for k, item in enumerate(items):
        w = item.split()
        moved = w[6 + k :] + w[: 6 + k]
        more = w[:20] + ["inserted"] * (k % 3) + w[20:40] + w[40 + k % 2 :]
        for part in (moved, more):
            docs.append(" ".join([prose(600 + k, 70), *part, prose(700 + k, 30)]))
    want = brute(docs, items)
    assert (4, 2) in want
    assert {(r.doc_id, r.item_id) for r in run(spark, docs, items).collect()} == want


def test_an_item_longer_than_the_narrow_counters(spark, monkeypatch):
    monkeypatch.setattr(D, "MOST_SHINGLES", 20)
    docs, items = data()
    assert {(r.doc_id, r.item_id) for r in run(spark, docs, items).collect()} == brute(docs, items)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_ITEMS", 5)
    docs, items = data()
    assert {(r.doc_id, r.item_id) for r in run(spark, docs, items).collect()} == brute(docs, items)


def test_plan_has_no_python(spark):
    docs, items = data()
    plan = run(spark, docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_index_finds_every_fingerprint_within_the_radius(spark):
    from pyspark.sql import functions as F

    r = random.Random(1)
    base = r.getrandbits(63)
    pairs = []
    for _ in range(200):
        other = base
        for bit in r.sample(range(63), 25):
            other ^= 1 << bit
        pairs.append((base, other))
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    shared = F.arrays_overlap(D.blocks(F.col("a"), 25), D.blocks(F.col("b"), 25))
    assert df.filter(shared).count() == 200


def test_edge_rows_and_clean_documents(spark):
    docs, items = data()
    bench = spark.createDataFrame([(1, items[3]), (None, items[4])], "item_id bigint, text string")
    assert D.contaminated(no_rows(spark), bench).collect() == []
    assert D.contaminated(edge_rows(spark), no_rows(spark).withColumnRenamed("doc_id", "item_id")).collect() == []
    df = frame(spark, [items[3], "clean words only in this one", None, items[4]])
    kept = D.clean_documents(df.union(df), bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 1, 2, 2]


def test_many_texts_with_items_are_not_broadcast(spark, monkeypatch):
    docs, items = data()
    bench = spark.createDataFrame([(1, items[3])], "item_id bigint, text string")
    df = frame(spark, [items[3], "clean words only in this one"])
    for most, few in ((1, True), (0, False)):
        monkeypatch.setattr(D, "BROADCAST_KEYS", most)
        kept = D.clean_documents(df, bench)
        assert broadcasts(kept) == few and [r.doc_id for r in kept.collect()] == [1]
