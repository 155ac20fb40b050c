"""Documents that come page by page: their pages are state, kept per document."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from kurzwerk.functions import text as X
from kurzwerk.params import Params
from kurzwerk.plans.intake import classify_documents
from kurzwerk.session import ship_package

#: State on disk, of which a batch commits the changes only; no batches without data, which
#: a run over what is there now would otherwise go on with for the sake of timers.
STATE_STORE = {
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


outcome = Row("doc", "joined", "num_pages", "n_page_errors", "complete", "late")


class DocumentPages(StatefulProcessor):
    """Pages of one document until it is complete or has been idle for too long.

    State: the list of its pages; one value with how many it expects and its timer; one
    that says it is closed, with the number of pages it then had. A closed document's
    pages are gone; what comes for it later is handed on as late.
    """

    def __init__(self, page_type: str, idle_ms: int | None):
        self.page_type = page_type
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getListState("pages", f"page_no {self.page_type}, text string")
        self.known = handle.getValueState("known", "expected bigint, timer bigint")
        self.closed = handle.getValueState("closed", "num_pages bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.closed.exists():
            late = [Row(page_no=r.page_no, text=r.text) for r in rows]
            yield outcome(key[0], None, self.closed.get()[0], 0, True, late)
            return
        expected, timer = self.known.get() if self.known.exists() else (None, None)
        for row in rows:
            self.pages.appendValue((row.page_no, row.text))
            if row.expected is not None:
                expected = max(expected or 0, row.expected)
        held = sorted(self.pages.get(), key=lambda p: (p[0] is not None, p[0]))
        complete = expected is not None and len(held) >= expected
        if complete:
            self.close_document(len(held), timer)
        else:
            self.known.update((expected, self.timer_after(timer, timerValues)))
        joined = "\n".join(p[1] or "" for p in held)
        failed = sum(p[1] is None for p in held)
        yield outcome(key[0], joined, len(held), failed, complete, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """An idle document is closed as it stands: its last outcome stays."""
        if self.pages.exists():
            self.close_document(sum(1 for _ in self.pages.get()), None)
        return iter(())

    def timer_after(self, timer: int | None, values) -> int | None:
        if self.idle_ms is None:
            return None
        if timer is not None:
            self.handle.deleteTimer(timer)
        due = values.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(due)
        return due

    def close_document(self, num_pages: int, timer: int | None) -> None:
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.pages.clear()
        self.known.clear()
        self.closed.update((num_pages,))

    def close(self) -> None:
        pass


def assembled_stream(
    pages: DataFrame,
    doc: str = "doc_id",
    page_no: str = "page_no",
    text: str = "text",
    expected: str | None = None,
    idle_ms: int | None = None,
) -> DataFrame:
    """Page stream -> a row per document and batch that brought pages of it.

    ``doc, joined, num_pages, n_page_errors, complete, late``. Call it where the session
    has RocksDB as its state store, as ``start_page_intake`` sees to.
    """
    types = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    total = F.col(expected).cast("bigint") if expected else F.lit(None).cast("bigint")
    rows = pages.select(
        F.col(doc).alias("doc"),
        F.col(page_no).alias("page_no"),
        F.col(text).alias("text"),
        total.alias("expected"),
    )
    made = rows.groupBy("doc").transformWithState(
        DocumentPages(types[page_no], idle_ms),
        f"doc {types[doc]}, joined string, num_pages bigint, n_page_errors bigint,"
        f" complete boolean, late array<struct<page_no:{types[page_no]},text:string>>",
        "Update",
        "None" if idle_ms is None else "ProcessingTime",
    )
    return made.withColumnRenamed("doc", doc)


def start_page_intake(
    pages: DataFrame,
    output: str,
    checkpoint: str,
    params: Params = Params(),
    doc: str = "doc_id",
    page_no: str = "page_no",
    text: str = "text",
    expected: str | None = None,
    idle_ms: int | None = None,
) -> StreamingQuery:
    """Classify documents from a stream of page rows, whenever pages of them arrive.

    The pages of open documents lie in the state store under their document: a batch
    reads those of the documents it touches and nothing else, however much came before.
    Outcomes are those of ``classify_pages`` over all pages so far; they are appended
    below ``output/outcomes``, a folder per batch, which a repeated batch overwrites.
    ``read_page_outcomes`` gives the newest of each document.

    ``expected`` names a column with the number of pages of the document (null where it
    is not known); with all of them there, the outcome has ``complete`` and the state is
    dropped. ``idle_ms`` drops the pages of documents for which nothing came for so long
    (looked at when a batch runs); without both, state is kept for good. Pages for a
    document whose state was dropped are not lost: they go to ``output/late``.
    """
    spark = pages.sparkSession
    ship_package(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # both tables come from one run over the state
        try:
            on_time = batch.filter("size(late) = 0").withColumn("text", X.strip(F.col("joined")))
            documents = on_time.select(
                doc,
                "text",
                "num_pages",
                X.n_chars(F.col("text")).alias("num_characters"),
                "n_page_errors",
                (F.col("text") != "").alias("has_text"),
                "complete",
            )
            outcomes = classify_documents(documents, params, doc, carry=["complete"])
            outcomes.write.mode("overwrite").parquet(f"{output}/outcomes/batch={batch_id}")
            late = batch.select(doc, F.explode("late").alias("page")).select(doc, "page.*")
            late.write.mode("overwrite").parquet(f"{output}/late/batch={batch_id}")
        finally:
            batch.unpersist()

    # A query keeps the settings it was started with.
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        return (
            assembled_stream(pages, doc, page_no, text, expected, idle_ms)
            .writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .outputMode("update")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def read_page_outcomes(spark: SparkSession, output: str, doc: str = "doc_id") -> DataFrame:
    """The newest outcome of every document of ``start_page_intake``."""
    every = spark.read.parquet(f"{output}/outcomes")
    age = F.struct("batch", "num_pages")
    newest = every.groupBy(F.col(doc).alias("_doc")).agg(F.max(age).alias("_age"))
    same = F.col(doc).eqNullSafe(F.col("_doc")) & (age == F.col("_age"))
    return every.join(newest, same, "left_semi").drop("batch")


def read_late_pages(spark: SparkSession, output: str) -> DataFrame:
    """Pages that came after their document's state was dropped."""
    return spark.read.parquet(f"{output}/late").drop("batch")
