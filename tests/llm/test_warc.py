import hashlib
import io
import os
from types import SimpleNamespace

import pytest

from kurzwerk.llm import warc


def record(i, payload):
    return SimpleNamespace(
        payload=payload, record_type="response", url=f"http://a.example/{i}?q=ü b", page_id=i,
        payload_digest=hashlib.sha1(payload).hexdigest(), payload_bytes=len(payload),
        refers_to=None, record_key=str(i),
    )


def found(raw, most=1 << 30):
    return list(warc.salvage(io.BytesIO(raw), most))


RECORDS = [warc.record_bytes(record(i, os.urandom(200 * i)), i % 2 == 0) for i in range(8)]


def test_plain_and_packed_records_are_read_in_order():
    rows = found(b"".join(RECORDS))
    assert [r[2] for r in rows] == [None] * 8
    assert [int(r[3][0][0]["x-page-id"]) for r in rows] == list(range(8))
    assert rows[-1][1] == sum(map(len, RECORDS))


@pytest.mark.parametrize("broken", range(8))
def test_a_damaged_record_is_one_gap_and_the_rest_is_read(broken):
    parts = list(RECORDS)
    half = len(parts[broken]) // 2
    parts[broken] = parts[broken][:half] + b"\x00\xff" * 20 + parts[broken][half + 40 :]
    rows = found(b"".join(parts))
    gaps = [r for r in rows if r[2]]
    begin = sum(map(len, parts[:broken]))
    assert [(g[0], g[1]) for g in gaps] == [(begin, begin + len(parts[broken]))]
    ids = [int(h["x-page-id"]) for r in rows for h, _ in r[3]]
    assert ids == [i for i in range(8) if i != broken]


def test_junk_before_between_and_behind():
    rows = found(b"junk\n" + RECORDS[1] + b"\x1f\x8b\x08 no member" + RECORDS[2] + RECORDS[3][:50])
    assert [bool(r[2]) for r in rows] == [True, False, True, False, True]
    assert rows[0][:2] == (0, 5) and rows[-1][1] - rows[-1][0] == 50


def test_nothing_and_no_more_than_allowed():
    assert found(b"") == []
    big = warc.record_bytes(record(1, b"x" * 100_000))
    assert [bool(r[2]) for r in found(big + RECORDS[2], 1000 + 400)] == [True, False]


def test_roundtrip_with_ties_nulls_and_repeated_rows(spark):
    long = "é" * 600
    rows = [(1, "u", long), (2, None, long), (3, "u", None), (4, "u", ""), (5, "u", "short"),
            (6, "u", "short"), (7, "u", long), (None, "u", "z" * 2000), (8, "u", long + "x"),
            (8, "u", long + "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = warc.roundtrip(spark, pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    for page_id, _, html in rows:
        assert by[page_id].payload_digest == sha(html)
        assert by[page_id].payload_bytes == len((html or "").encode())
    assert {k for k, r in by.items() if r.record_type == "revisit"} == {1, 2}
    assert by[1].refers_to == by[2].refers_to == 7 and by[7].refers_to is None


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string, payload int")
    assert warc.roundtrip(spark, pages).collect() == []


def test_damage_in_files_is_told_with_its_bytes(spark, tmp_path):
    raw = RECORDS[0] + b"torn" + RECORDS[2]
    (tmp_path / "a.warc.gz").write_bytes(raw)
    (tmp_path / "empty.warc").write_bytes(b"")
    names = [str(tmp_path / n) for n in ("a.warc.gz", "empty.warc", "missing.warc")]
    files = spark.createDataFrame([(n,) for n in names], "file string")
    rows = warc.read_warc(files).collect()
    assert sorted(r.headers["x-page-id"] for r in rows if not r.fault) == ["0", "2"]
    gaps = {(os.path.basename(r.file), r.start, r.end) for r in rows if r.fault}
    start = len(RECORDS[0])
    assert gaps == {("a.warc.gz", start, start + 4), ("missing.warc", 0, 0)}


def test_a_plain_record_right_behind_a_damaged_member():
    parts = [warc.record_bytes(record(1, b"a" * 500)), warc.record_bytes(record(2, b"b\n" * 9), False)]
    parts[0] = parts[0][:40] + b"\x00" * 30 + parts[0][70:]
    rows = found(b"".join(parts))
    assert [bool(r[2]) for r in rows] == [True, False] and rows[0][1] == len(parts[0])


@pytest.mark.parametrize("packed", [True, False])
def test_long_heads_are_read_and_endless_ones_are_damage(packed):
    long = record(1, b"x")
    long.url = "http://a.example/" + "u" * 300_000
    good = warc.record_bytes(record(2, b"y"))
    rows = found(warc.record_bytes(long, packed) + good)
    assert [len(r[3]) for r in rows] == [1, 1]
    assert rows[0][3][0][0]["warc-target-uri"] == long.url
    broken = b"WARC/1.0\r\nA: " + os.urandom(200_000).replace(b"\r", b"x") + good
    assert [bool(r[2]) for r in found(broken)] == [True, False]


def test_long_urls_and_clashing_names_come_back(spark):
    rows = [(1, "http://a/" + "x" * 100_000, "h" * 2000, "f", 1, "r"), (2, "u", "é" * 1_500_000, "f", 2, "r")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, file string, n_records int, shared_digest string")
    got = sorted(tuple(r)[:2] for r in warc.roundtrip(spark, pages).collect())
    assert got == [(1, 2000), (2, 3_000_000)]


def test_a_missing_or_damaged_file_stops_a_whole_read(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 5000)], "page_id bigint, url string, html string")
    files = warc.write_warc(pages, str(tmp_path)).collect()
    again = spark.createDataFrame(files)
    assert warc.read_warc(again, whole=True).count() == 1
    more = spark.createDataFrame([(f.file, f.n_records + 1) for f in files], "file string, n_records bigint")
    with pytest.raises(Exception, match="records of"):
        warc.read_warc(more, whole=True).collect()
    path = files[0].file
    raw = open(path, "rb").read()
    open(path, "wb").write(raw[:60])
    with pytest.raises(Exception, match="cut off"):
        warc.read_warc(again, whole=True).collect()
    assert warc.read_warc(again).filter("fault is not null").count() == 1
    os.remove(path)
    with pytest.raises(Exception, match="FileNotFound|No such file"):
        warc.read_warc(again, whole=True).collect()
