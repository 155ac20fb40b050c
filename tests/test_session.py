import pyarrow as pa

from kurzwerk.functions.batches import BATCH_SETTING
from kurzwerk.session import remove_work, scale_settings, ship_package, work_dir


def test_blocks_of_a_shuffle_stay_bounded():
    for size in (1 << 30, 1 << 40, 100 << 40):
        s = scale_settings(size)
        partitions = int(s["spark.sql.shuffle.partitions"])
        splits = -(-size // int(s["spark.sql.files.maxPartitionBytes"]))
        assert 200 <= partitions <= 50_000 and splits <= 110_000


def test_work_folders_can_be_removed(spark, tmp_path):
    place = work_dir(spark, "some")
    spark.range(3).write.parquet(place)
    remove_work(spark, place)
    remove_work(spark, place)
    assert spark.range(1).count() == 1


def test_batches_are_bounded_by_bytes_unless_the_session_says_otherwise(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "b": [batch.nbytes]})

    session = spark.newSession()
    session.conf.set(BATCH_SETTING, "3m")
    ship_package(session)
    assert session.conf.get(BATCH_SETTING) == "3m"
    session.conf.unset(BATCH_SETTING)
    ship_package(session)
    rows = session.range(0, 4000, 1, 1).selectExpr("repeat('x', 10000) t")
    got = rows.mapInArrow(sizes, "n long, b long").collect()
    assert sum(r.n for r in got) == 4000 and max(r.b for r in got) <= 9 << 20
