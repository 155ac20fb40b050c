"""The registered queries: every operator over whole tables of the test data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kurzwerk.functions import text as X
from kurzwerk.functions.tokens import Subwords
from kurzwerk.operators import chunking as C
from kurzwerk.operators import evaluation as E
from kurzwerk.operators import metrics as M
from kurzwerk.operators import pages as PG
from kurzwerk.operators import rouge as R
from kurzwerk.operators import summarize as S
from kurzwerk.operators import validation as V
from kurzwerk.params import Params
from kurzwerk.plans import evaluate as PE
from kurzwerk.plans import intake as PI
from kurzwerk.plans import summarise as PS
from kurzwerk.session import ship_package, work_dir
from kurzwerk.sources import corpus, reports
from kurzwerk.sources.uploads import plain_text_pages, python_pages
from kurzwerk.streaming import documents as SD
from kurzwerk.streaming import intake as SI

Query = Callable[[SparkSession, str], DataFrame]

MAX, OVERLAP = 100, 10
ARTICLE_CHARS = 4000
MODEL_TOKENS = 60
UPLOAD_PARAMS = Params(max_file_size=4000, max_pages=5)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    return corpus.read_table(spark, sf, "documents")


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    return corpus.read_table(spark, sf, "conversations")


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", X.clean_text(F.col("text")).alias("text"))


def dirtied(text: Column) -> Column:
    """Extraction artefacts put into clean prose: CRLF, hyphen breaks, blank runs."""
    text = F.replace(text, F.lit("\n"), F.lit("\r\n"))
    text = F.regexp_replace(text, "([a-zäöüß]{5})([a-zäöüß]{5})", "$1-\n$2")
    return F.replace(text, F.lit(". "), F.lit(".\t "))


def uploads(spark: SparkSession, sf: str, lines_as_pages: bool = True) -> DataFrame:
    """Data URLs of the documents, with every kind of bad upload among them."""
    doc = F.col("doc_id")
    ending = F.when(doc % 5 == 0, ".PDF").when(doc % 5 == 1, ".docx").otherwise(".pdf")
    payload = (
        F.when(doc % 19 == 0, "")
        .when(doc % 23 == 0, "//5B")
        .when(doc % 29 == 0, F.base64(F.lit(" \n\t ").cast("binary")))
        .otherwise(F.base64(F.col("text").cast("binary")))
    )
    comma = F.when(doc % 17 == 0, "").otherwise(",")
    contents = F.concat(F.lit("data:application/pdf;base64"), comma, payload)
    return documents(spark, sf).select(
        "doc_id",
        F.concat(F.lit("doc_"), doc.cast("string"), ending).alias("filename"),
        F.when(doc % 31 != 0, contents).alias("contents"),
    )


def page_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as documents, turns as pages, system turns as failed pages."""
    return conversations(spark, sf).select(
        F.col("conv_id").alias("doc_id"),
        F.col("turn").alias("page_no"),
        F.when(F.col("role") != "system", F.col("text")).alias("text"),
    )


def chunk_table(spark: SparkSession, sf: str) -> DataFrame:
    return C.chunk_text(cleaned(spark, sf), max_tokens=MAX, overlap_tokens=OVERLAP)


def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A user turn as reference, the assistant turn after it as candidate."""
    turns = conversations(spark, sf)
    user = turns.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("reference")
    )
    answer = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("candidate")
    )
    return user.join(answer, ["conv_id", "turn"]).select(
        F.concat_ws("-", "conv_id", "turn").alias("pair_id"), "reference", "candidate"
    )


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their first three sentences as a stand-in for a reference summary."""
    lead = F.array_join(F.slice(X.sentences(X.clean_text(F.col("text"))), 1, 3), " ")
    return documents(spark, sf).select(
        F.col("doc_id").alias("example_id"),
        F.col("text").alias("article"),
        lead.alias("reference"),
    )


def turn_results(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as chunk results: the text before the first stop is the summary.

    Turns of the system have no model name; some turns are failed chunks.
    """
    text = F.col("text")
    return conversations(spark, sf).select(
        F.col("conv_id").alias("doc_id"),
        F.col("turn").alias("chunk_no"),
        text.alias("chunk"),
        F.concat(F.lit(" "), F.substring_index(text, ".", 1)).alias("summary"),
        F.when(F.col("role") != "system", F.col("role")).alias("model_name"),
        F.when(F.length(text) % 7 == 3, "refused").alias("error"),
        F.lit(None).cast("double").alias("elapsed"),
    )


# --- text -----------------------------------------------------------------


def q_clean_text(spark, sf):
    raw = documents(spark, sf).select("doc_id", dirtied(F.col("text")).alias("raw"))
    return raw.select("doc_id", X.clean_text(F.col("raw")).alias("clean")).withColumn(
        "n_chars", X.n_chars(F.col("clean"))
    )


def q_clean_text_raw(spark, sf):
    return cleaned(spark, sf).withColumn("n_chars", X.n_chars(F.col("text")))


def q_word_tokens(spark, sf):
    rows = documents(spark, sf).select(
        "doc_id", F.posexplode_outer(X.word_tokens(F.col("text"))).alias("pos", "token")
    )
    return rows.filter(F.col("token").isNotNull()).withColumn("pos", F.col("pos").cast("bigint"))


def q_sentences(spark, sf):
    return cleaned(spark, sf).select(
        "doc_id", F.posexplode_outer(X.sentences(F.col("text"))).alias("sent_no", "sentence")
    ).select(
        "doc_id",
        F.col("sent_no").cast("bigint").alias("sent_no"),
        "sentence",
        X.unit_count(F.col("sentence")).cast("bigint").alias("n_tokens"),
    )


def q_truncate_tokens(spark, sf):
    cut = cleaned(spark, sf).select("doc_id", X.truncate_units(F.col("text")).alias("c"))
    return cut.select("doc_id", "c.text", "c.truncated")


def q_truncate_chars(spark, sf):
    return documents(spark, sf).select(
        "doc_id", X.truncate_chars(F.col("text"), ARTICLE_CHARS).alias("article")
    )


# --- chunks ---------------------------------------------------------------


def with_length(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "doc_id",
        F.col("chunk_no").cast("bigint").alias("chunk_no"),
        "chunk",
        X.n_chars(F.col("chunk")).alias("n_chars"),
    )


def q_chunk_text(spark, sf):
    return with_length(chunk_table(spark, sf))


def q_chunk_text_default(spark, sf):
    return with_length(C.chunk_text(cleaned(spark, sf)))


def q_chunk_counts(spark, sf):
    arrays = C.chunk_arrays(cleaned(spark, sf), max_tokens=MAX, overlap_tokens=OVERLAP)
    return arrays.select(
        "doc_id",
        F.size("chunks").cast("bigint").alias("n_chunks"),
        F.aggregate(
            "chunks", F.lit(0).cast("bigint"), lambda n, c: n + F.length(c)
        ).alias("input_characters"),
    )


def subwords() -> Subwords:
    import public_tokenizers

    return Subwords(public_tokenizers.path("byte_bpe_50k.json"))


def q_bpe_token_count(spark, sf):
    return cleaned(spark, sf).select(
        "doc_id", subwords().count(F.col("text")).cast("bigint").alias("n_tokens")
    )


def q_bpe_chunks(spark, sf):
    return with_length(C.chunk_text(cleaned(spark, sf), counter=subwords()))


# --- intake ---------------------------------------------------------------


def q_decode_upload(spark, sf):
    decoded = PI.decode_uploads(uploads(spark, sf), ["doc_id"])
    return decoded.select("doc_id", "decodable", "size", F.hex("content").alias("content_hex"))


def q_classify_upload(spark, sf):
    return PI.classify_uploads(
        uploads(spark, sf), plain_text_pages("\n"), UPLOAD_PARAMS, ["doc_id"]
    )


def q_quarantine(spark, sf):
    bad = V.quarantined(q_classify_upload(spark, sf))
    return bad.groupBy("status", "reason").agg(F.count("*").alias("n_uploads"))


def lines_of(content: bytes):
    return content.decode("utf-8").split("\n")


def q_extract_hook(spark, sf):
    return PI.classify_uploads(
        uploads(spark, sf), python_pages(lines_of), UPLOAD_PARAMS, ["doc_id"]
    )


def q_assemble_pages(spark, sf):
    return PG.assemble_pages(page_rows(spark, sf))


def q_classify_pages(spark, sf):
    return PI.classify_pages(page_rows(spark, sf), UPLOAD_PARAMS)


def q_non_empty(spark, sf):
    """Request filter: turns without any word are empty requests."""
    turns = conversations(spark, sf).select(
        "conv_id", "turn", F.when(F.col("role") != "system", F.col("text")).alias("text")
    )
    return V.non_empty(V.present(turns, "text")).select("conv_id", "turn")


def q_incremental_intake(spark, sf):
    """The uploads as a stream of files, read back from the sink."""
    place = work_dir(spark, "incremental-intake")
    uploads(spark, sf).write.parquet(f"{place}/in")
    schema = spark.read.parquet(f"{place}/in").schema
    stream = SI.read_stream(spark, f"{place}/in", schema, files_per_batch=4)
    SI.start_intake(
        stream,
        plain_text_pages("\n"),
        f"{place}/out",
        f"{place}/state",
        UPLOAD_PARAMS,
        ["doc_id"],
    ).awaitTermination()
    return spark.read.parquet(f"{place}/out")


def q_incremental_pages(spark, sf):
    """Page rows as a stream; a third of each document's pages comes before each restart."""
    place = work_dir(spark, "incremental-pages")
    pages = page_rows(spark, sf)
    for part in range(3):
        some = pages.filter(F.pmod(F.col("page_no"), F.lit(3)) == part)
        some.write.mode("append").parquet(f"{place}/in")
        stream = SI.read_stream(spark, f"{place}/in", pages.schema)
        SD.start_page_intake(stream, f"{place}/out", f"{place}/state", UPLOAD_PARAMS).awaitTermination()
    return SD.read_page_outcomes(spark, f"{place}/out").drop("complete")


# --- summaries and metrics --------------------------------------------------


def q_summarize_chunks(spark, sf):
    done = S.summarize_chunks(chunk_table(spark, sf), max_tokens=40, min_tokens=10)
    return done.select(
        "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "summary", "model_name"
    )


def q_merge_summaries(spark, sf):
    merged = M.merge_summaries(turn_results(spark, sf), source_words=False)
    return merged.drop("elapsed")


def q_document_record(spark, sf):
    """The same results with all figures, failed documents included."""
    merged = M.merge_summaries(turn_results(spark, sf))
    return M.document_record(merged).drop("processing_time_seconds")


def q_compression(spark, sf):
    done = S.summarize_chunks(chunk_table(spark, sf), max_tokens=40, min_tokens=10)
    merged = M.merge_summaries(done, source_words=False)
    sizes = merged.select(
        "doc_id", "input_characters", X.n_chars(F.col("summary")).alias("summary_characters")
    )
    s, i = F.col("summary_characters"), F.col("input_characters")
    return sizes.withColumn("ratio", F.when(i == 0, 0.0).otherwise(s / i)).withColumn(
        "compression_rate", M.compression_rate(s, i)
    )


def q_coverage(spark, sf):
    """Words of a user's turn covered by the answer after it."""
    pairs = turn_pairs(spark, sf)
    words = pairs.select(
        "pair_id",
        F.array_distinct(X.word_tokens(F.col("candidate"))).alias("source"),
        X.word_tokens(F.col("reference")).alias("words"),
    )
    return words.select(
        "pair_id",
        M.covered_words(F.col("source"), F.col("words")).alias("covered"),
        F.size("words").cast("bigint").alias("n_words"),
    ).withColumn("coverage", M.coverage(F.col("covered"), F.col("n_words")))


def q_document_report(spark, sf):
    """The whole way from raw documents to result records, with the default limits."""
    return PS.summarise_documents(documents(spark, sf)).drop("processing_time_seconds")


def q_document_report_small_window(spark, sf):
    """As ``document_report`` for a model with a small window: many chunks per document."""
    params = Params(max_tokens=MAX, overlap_tokens=OVERLAP, max_summary_tokens=40, min_summary_tokens=10)
    return PS.summarise_documents(documents(spark, sf), params=params).drop(
        "processing_time_seconds"
    )


def load_first_words():
    """A stand-in model: the first words of a text, refusing texts with a capital Z."""

    def model(texts: list[str]) -> list[str]:
        for t in texts:
            if "Z" in t:
                raise ValueError("refused")
        return [" ".join(t.split(" ")[:12]) + " " for t in texts]

    return model


def q_map_summarizer(spark, sf):
    params = Params(
        max_tokens=MAX,
        overlap_tokens=OVERLAP,
        model_input_tokens=MODEL_TOKENS,
        model_name="first-words",
    )
    return PS.summarise_with_model(documents(spark, sf), load_first_words, params=params).drop(
        "processing_time_seconds"
    )


# --- evaluation -------------------------------------------------------------


def rouge_part(spark, sf, name: str) -> DataFrame:
    scores = R.rouge_scores(
        turn_pairs(spark, sf),
        orders=(int(name[-1]),) if name != "rougeL" else (),
        longest=name == "rougeL",
        stem=False,
    )
    return scores


def q_rouge1(spark, sf):
    return rouge_part(spark, sf, "rouge1")


def q_rouge2(spark, sf):
    return rouge_part(spark, sf, "rouge2")


def q_rouge_l(spark, sf):
    return R.rouge_scores(turn_pairs(spark, sf), orders=(1,), stem=False).select(
        "pair_id",
        "rougeL_overlap",
        "rougeL_reference",
        "rougeL_candidate",
        "rougeL_p",
        "rougeL_r",
        "rougeL_f",
    )


def q_rouge_stemmed(spark, sf):
    return R.rouge_scores(turn_pairs(spark, sf))


def q_eval_detail(spark, sf):
    detail = PE.detail_of(articles(spark, sf), stem=False)
    return detail.drop("processing_time_seconds", "error")


def timeless_report(detail: DataFrame) -> DataFrame:
    """The report with the article length in the place of the measured time."""
    timed = detail.withColumn(
        "processing_time_seconds", F.col("input_characters").cast("double")
    )
    report = E.evaluation_report(timed.drop("error"), S.EXTRACTIVE, "documents")
    return report.withColumnsRenamed(
        {
            "processing_time_seconds_mean": "input_characters_mean",
            "processing_time_seconds_p95": "input_characters_p95",
        }
    )


def written_detail(spark, sf) -> DataFrame:
    detail = PE.detail_of(articles(spark, sf), stem=False)
    return reports.materialize(detail, work_dir(spark, "evaluation-detail"))


def q_eval_report(spark, sf):
    return timeless_report(written_detail(spark, sf))


def q_report_json(spark, sf):
    """The report written as JSON and read back."""
    place = work_dir(spark, "report")
    report = timeless_report(written_detail(spark, sf))
    reports.write_report(report, place)
    return reports.read_report(spark, place, report.schema)


def q_detail_csv(spark, sf):
    """The detail table written as CSV and read back."""
    place = work_dir(spark, "detail")
    detail = q_eval_detail(spark, sf)
    reports.write_detail(detail, place)
    return reports.read_detail(spark, place, detail.schema)


def q_quantile(spark, sf):
    p95 = E.exact_quantile(documents(spark, sf), "n_chars", 0.95)
    return spark.range(1).select(F.bround(F.lit(p95), 6).alias("n_chars_p95"))


def q_eval_hook(spark, sf):
    """The report of an evaluation with a user's model that refuses some articles."""
    place = work_dir(spark, "evaluation-hook")
    detail = PE.detail_of(articles(spark, sf), stem=False, load=load_first_words)
    detail = reports.materialize(detail, place)
    report = E.evaluation_report(detail, "first-words", "documents")
    return report.drop("processing_time_seconds_mean", "processing_time_seconds_p95")


def q_sample_articles(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    return corpus.sample(table.select("doc_id", "text"), "doc_id", 30)


def q_window_report(spark, sf):
    """How the corpus is cut for a model with a window of n tokens (the flagship)."""
    per_doc = q_chunk_counts(spark, sf)
    return per_doc.groupBy("n_chunks").agg(
        F.count("*").alias("n_documents"),
        F.sum("input_characters").alias("input_characters"),
    )


def registered() -> dict[str, Query]:
    return {
        name[2:]: value
        for name, value in globals().items()
        if name.startswith("q_") and callable(value)
    }
