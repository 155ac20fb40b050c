import base64

import pytest
from pyspark.sql import functions as F

from kurzwerk import params as P
from kurzwerk.operators import pages as PG
from kurzwerk.operators import validation as V
from kurzwerk.params import Params
from kurzwerk.plans import intake as PI
from kurzwerk.sources import folder as SF
from kurzwerk.sources import uploads as U

HEAD = "data:application/pdf;base64,"


def data_url(content: bytes) -> str:
    return HEAD + base64.b64encode(content).decode()


def outcomes(spark, rows, extractor=None, params=Params()):
    df = spark.createDataFrame(rows, "filename string, contents string")
    got = PI.classify_uploads(df, extractor or U.plain_text_pages(), params)
    return {r.filename: r for r in got.collect()}


def test_decode(spark):
    payloads = ["", "QUJD", "QUI=", "QQ==", "QUJD!!", "QU\nJD", "Q U J D", "QUJDé", "QUJ", "Q", "=", "QQ=", "QUJD====", "Q!UI="]
    df = spark.createDataFrame([(HEAD + p,) for p in payloads], "c string")
    got = [r[0] for r in df.select(V.decode_data_url(F.col("c"))).collect()]

    def plain(p):
        try:
            return base64.b64decode(p)
        except ValueError:
            return None

    for p, g in zip(payloads, got):
        want = plain(p)
        if p in ("=", "QUJD===="):  # misplaced padding: refused here
            assert g is None
        else:
            assert (bytes(g) if g is not None else None) == want, p
    no_comma = spark.createDataFrame([("QUJD",)], "c string")
    assert no_comma.select(V.decode_data_url(F.col("c"))).first()[0] is None
    content = b"%PDF-1.4 test content"
    one = spark.createDataFrame([(data_url(content),)], "c string")
    assert bytes(one.select(V.decode_data_url(F.col("c"))).first()[0]) == content


def test_every_status(spark):
    params = Params(max_file_size=40, max_pages=2)
    got = outcomes(
        spark,
        [
            ("a.pdf", data_url(b"Seite-\neins\fSeite zwei")),
            ("b.pdf", "kein komma"),
            ("c.docx", data_url(b"text")),
            ("d.pdf", HEAD),
            ("e.pdf", data_url(b"x" * 41)),
            ("f.PDF", data_url(b"x" * 40)),
            ("g.pdf", data_url(b"\xff\xfe")),
            ("h.pdf", data_url(b" \f\n ")),
            ("i.pdf", data_url(b"1\f2\f3")),
            ("j.docx", "kein komma"),
            (None, data_url(b"x")),
            ("k.pdf", None),
        ],
        params=params,
    )
    assert {n: (r.status, r.reason) for n, r in got.items()} == {
        "a.pdf": ("success", None),
        "b.pdf": ("error", "undecodable"),
        "c.docx": ("error", "extension"),
        "d.pdf": ("error", "empty"),
        "e.pdf": ("error", "oversize"),
        "f.PDF": ("success", None),
        "g.pdf": ("error", "unreadable"),
        "h.pdf": ("error", "no_text"),
        "i.pdf": ("warning", "page_cap"),
        "j.docx": ("error", "undecodable"),
    }
    a = got["a.pdf"]
    assert (a.text, a.num_pages, a.num_characters, a.ready) == ("Seiteeins Seite zwei", 2, 22, True)
    assert a.message == "✅ 'a.pdf' erfolgreich verarbeitet (2 Seiten, 22 Zeichen)."
    assert got["c.docx"].message.endswith("(erhalten: 'c.docx').")
    assert got["i.pdf"].text is None and "hat 3 Seiten" in got["i.pdf"].message
    assert Params().size_limit_text == "20"
    assert P.MSG_OVERSIZE % Params().size_limit_text in (
        "Die Datei ist größer als das erlaubte Limit von 20 MB."
    )


def test_reader_hook_isolates_pages_and_files(spark):
    def broken_reader(content: bytes):
        if not content.startswith(b"%PDF"):
            raise ValueError("no header")

        def bad():
            raise RuntimeError("page")

        return ["eins", None, bad, lambda: "vier"]

    got = outcomes(
        spark,
        [
            ("a.pdf", data_url(b"%PDF-1.4")),
            ("b.pdf", data_url(b"das ist definitiv kein PDF")),
            ("c.txt", data_url(b"%PDF-1.4")),
        ],
        U.python_pages(broken_reader),
    )
    assert (got["a.pdf"].text, got["a.pdf"].num_pages) == ("eins vier", 4)
    assert got["b.pdf"].reason == "unreadable" and got["c.txt"].reason == "extension"


def some_files(place):
    (place / "sub" / "deep").mkdir(parents=True)
    (place / "_hidden").mkdir()
    for name, content in {
        "a b.pdf": b"Text", "sub/leer.pdf": b"", "gross.PDF": b"x" * 101, "notiz.txt": b"Text",
        "sub/a b.pdf": b"Anders", "sub/deep/ü.pdf": b"tief", "_hidden/x.pdf": b"x", ".y.pdf": b"y",
    }.items():
        (place / name).write_bytes(content)


def test_folder_of_files(spark, tmp_path):
    some_files(tmp_path)
    files = U.read_files(spark, str(tmp_path), Params(max_file_size=100))
    twins = files.filter("filename = 'a b.pdf'").collect()
    assert len({r.path for r in twins}) == 2
    assert {bytes(r.content) for r in twins} == {b"Text", b"Anders"}
    assert files.filter("filename = 'notiz.txt'").first().content is None
    assert files.filter("filename = 'gross.PDF'").first().content is None
    got = PI.classify_files(files, U.plain_text_pages(), Params(max_file_size=100)).collect()
    reasons = {r.filename: r.reason for r in got}
    assert reasons == {
        "a b.pdf": None, "ü.pdf": None, "leer.pdf": "empty", "gross.PDF": "oversize", "notiz.txt": "extension"
    }


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_a_listing_decides_filters_and_leaves_the_depth_to_tasks(spark, tmp_path, levels):
    some_files(tmp_path)
    every = SF.list_files(spark, f"file:{tmp_path}", levels=levels)
    assert sorted(r.filename for r in every.collect()) == sorted(
        ["a b.pdf", "a b.pdf", "gross.PDF", "leer.pdf", "notiz.txt", "ü.pdf"]
    )
    assert every.rdd.getNumPartitions() == [1, 2, 3][levels]
    some = every.filter("size <= 100 and size > 0 and endswith(filename, '.pdf')")
    assert sorted(r.size for r in some.collect()) == [4, 4, 6]
    assert "Filter" not in some._jdf.queryExecution().executedPlan().toString().split("Scan")[0]
    reader = SF.FolderReader({"path": str(tmp_path)})
    kept = [SF.LessThanOrEqual(("size",), 100), SF.StringEndsWith(("filename",), "pdf")]
    other = [SF.Filter(), SF.EqualTo(("length",), 1)]
    assert list(reader.pushFilters(kept + other)) == other
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["size"] for r in rows) == [0, 4, 4, 6]


def test_a_stream_of_files_equals_the_batch(spark, tmp_path):
    place = tmp_path / "in"
    place.mkdir()
    params = Params(max_file_size=100)

    def run():
        stream = U.stream_files(spark, str(place), params, tasks=2)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect(), key=repr)

    assert run() == []
    some_files(place)
    first = run()
    assert first == sorted(U.read_files(spark, str(place), params).collect(), key=repr) and len(first) == 6
    (place / "sub" / "neu.pdf").write_bytes(b"neu")
    assert len(run()) == 7 == len(run())


def test_a_file_that_is_gone_stops_the_job(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    listing = SF.list_files(spark, str(tmp_path)).collect()
    (tmp_path / "a.pdf").unlink()
    gone = spark.createDataFrame(listing, SF.LISTING)
    with pytest.raises(Exception, match="FileNotFound|No such file"):
        SF.with_contents(gone, ".pdf", 10).collect()
    assert SF.list_files(spark, str(tmp_path)).collect() == []


def test_accepted_and_quarantined_part_the_outcomes(spark):
    df = spark.createDataFrame(
        [("a.pdf", data_url(b"x")), ("b.txt", data_url(b"x"))], "filename string, contents string"
    )
    all_ = PI.classify_uploads(df, U.plain_text_pages())
    assert [r.filename for r in V.accepted(all_).collect()] == ["a.pdf"]
    assert [r.filename for r in V.quarantined(all_).collect()] == ["b.txt"]


def test_page_rows(spark):
    rows = [
        (1, 2, "zwei"), (1, 1, " eins"), (1, 3, None),
        (2, 1, None), (2, 2, " \n"),
        (3, 1, "a"), (3, 2, "b"), (3, 3, "c"), (3, 4, "d"),
    ]
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, text string")
    got = {r.doc_id: r for r in PG.assemble_pages(pages).collect()}
    assert (got[1].text, got[1].num_pages, got[1].num_characters, got[1].n_page_errors) == ("eins\nzwei", 3, 9, 1)
    assert (got[2].text, got[2].has_text) == ("", False)
    assert (got[3].text, got[3].num_pages, got[3].num_characters) == ("a\nb\nc\nd", 4, 7)
    status = {r.doc_id: r for r in PI.classify_pages(pages, Params(max_pages=3)).collect()}
    assert {k: r.reason for k, r in status.items()} == {1: None, 2: "no_text", 3: "page_cap"}
    assert (status[3].text, status[3].num_pages, status[3].num_characters) == (None, 4, 7)


def test_a_document_with_a_third_of_all_pages(spark):
    hot = spark.range(30_000).selectExpr("0L doc_id", "id page_no", "'seite' text")
    rest = spark.range(60_000).selectExpr("1 + id % 20000 doc_id", "id page_no", "'x' text")
    docs = PG.assemble_pages(hot.union(rest))
    got = docs.filter("doc_id = 0").first()
    assert (got.num_pages, got.num_characters, got.has_text) == (30_000, 30_000 * 6 - 1, True)
    assert docs.filter("text = 'x\nx\nx'").count() == 20_000


def test_parameters_from_the_environment():
    got = Params.from_env({"MAX_FILE_SIZE_MB": "3", "MAX_SUMMARY_TOKENS": "99", "SUMMARIZATION_MODEL": "m"})
    assert (got.max_file_size, got.max_summary_tokens, got.min_summary_tokens, got.model_name) == (3 * 1024 * 1024, 99, 30, "m")


def test_pdf_reader_needs_its_package():
    pytest.importorskip("pypdf")
    with pytest.raises(Exception):
        U.pypdf_reader(b"not a document")
