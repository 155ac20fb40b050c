import random

import numpy as np
from samples import broadcasts

from kurzwerk.llm import common as C


def test_tables_of_powers_are_shared_and_no_longer_than_asked(monkeypatch):
    monkeypatch.setattr(C, "POWERS", {})
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    for seed in range(8):
        C.Rolling(seed).prefix(data[: 100 * seed + 200])
    assert {len(up) for up, _ in C.POWERS.values()} == {801, 901}
    for base, (up, down) in C.POWERS.items():
        assert all(int(up[k]) == pow(base, k, 1 << 64) for k in range(0, 801, 50))
        assert set((up * down).tolist()) == {1}


def test_equal_stretches_have_equal_hashes_wherever_they_are():
    data = np.frombuffer(random.Random(2).randbytes(300) * 3, np.uint8)
    for seed in (1, 2):
        r = C.Rolling(seed)
        at = np.arange(0, 500)
        names = r.between(r.prefix(data), at, at + 100)
        assert len(set(names.tolist())) == 300 and (names[:200] == names[300:500]).all()


def test_tables_go_when_another_operator_works(monkeypatch):
    monkeypatch.setattr(C, "TABLES", {})
    monkeypatch.setattr(C, "LAST", [])
    one, two = C.kept_tables("one"), C.kept_tables("two")
    C.work_of("one")
    one["a"] = 1
    C.work_of("one")
    assert one == {"a": 1}
    C.work_of("two")
    two["b"] = 2
    assert one == {} and C.kept_tables("two") == {"b": 2}


def test_sides_of_joins_are_broadcast_by_their_counted_rows_alone(spark, tmp_path):
    spark.range(1000).selectExpr("id div 900 AS id").write.parquet(str(tmp_path / "t"))
    side = spark.read.parquet(str(tmp_path / "t"))
    rows = spark.range(5)
    for bounded in (C.free_up_to, C.broadcast_up_to):
        assert broadcasts(rows.join(bounded(side, 1000), "id"))
        assert not broadcasts(rows.join(bounded(side, 999), "id"))
        assert not broadcasts(rows.join(bounded(side, 999), "id", "left_anti"))
        assert rows.join(bounded(side, 999), "id").count() == 1000


def test_likely_rows_hold_all_keys_and_few_others(spark, monkeypatch):
    from pyspark.sql import functions as F

    digest = F.unhex(F.md5(F.col("id").cast("string"))).alias("digest")
    keys, rows = spark.range(3000).select("id", digest), spark.range(30_000).select("id", digest)
    for on in ("digest", "id"):
        chosen = C.likely(keys, on)
        passed = {r.id for r in chosen(rows, on).collect()}
        assert passed >= set(range(3000)) and len(passed) < 6000
        rest = chosen(rows, on, held=False)
        assert rest.columns == rows.columns
        assert sorted([*passed, *(r.id for r in rest.collect())]) == list(range(30_000))
    assert C.likely(keys.limit(0), "id")(rows, "id").count() == 0
    # A map that is too small lets more through and loses nothing.
    monkeypatch.setattr(C, "MOST_KEY_BITS", 12)
    passed = {r.id for r in C.likely(keys, "id")(rows, "id").collect()}
    assert passed >= set(range(3000)) and len(passed) > 10_000
