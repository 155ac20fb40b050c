"""The registered queries of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kurzwerk.llm import (
    byte_bpe,
    class_lm,
    decontaminate,
    fill_middle,
    html_text,
    lexical_search,
    licences,
    near_dedup,
    quality,
    suffix_dedup,
    token_counts,
    token_files,
    warc,
)
from kurzwerk.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.roundtrip(spark, read_table(spark, sf, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf, "documents"))


def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    return token_counts.token_counts(docs, vocabulary("piece_bpe_32k.model"))


def op4_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_classes(read_table(spark, sf, "documents")).drop("digest")


def op5_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    return byte_bpe.digests(docs, vocabulary("byte_bpe_multi_50k.tiktoken"))


def op6_token_files(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    return token_files.roundtrip(spark, docs, vocabulary("word_bpe_49k.json"))


def op7_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    return decontaminate.contaminated(docs, read_table(spark, sf, "benchmark"))


def op8_class_lm(spark: SparkSession, sf: str) -> DataFrame:
    return class_lm.score(read_table(spark, sf, "documents"))


def op9_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf, "pages"))


def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_rules(read_table(spark, sf, "documents"))


def op11_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    return lexical_search.search(docs, read_table(spark, sf, "benchmark"))


def op12_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licences.summary(read_table(spark, sf, "documents"))


def op13_fill_middle(spark: SparkSession, sf: str) -> DataFrame:
    return fill_middle.digests(read_table(spark, sf, "documents"))


def registered() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


OP1_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest
  FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END
    AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
FROM m
"""


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), f AS (
  SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term
), d AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id
), s AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM d
), m AS (
  SELECT doc_id, 50 + (50 * n * docs) // len AS m FROM d, s
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM f, s GROUP BY term, docs
), r AS (
  SELECT item_id, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM i JOIN f USING (term) JOIN w USING (term) JOIN m USING (doc_id)
  GROUP BY item_id, doc_id
)
SELECT item_id, doc_id, score,
  row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
FROM r WHERE score > 0
QUALIFY rank <= 50
"""

OP13_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), g AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x,
    ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y,
    CASE
      WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
        OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm'
      ELSE 'psm'
    END AS form
  FROM d
), c AS (
  SELECT *, substring(t, 1, least(x, y)) AS p, substring(t, greatest(x, y) + 1) AS s,
    substring(t, least(x, y) + 1, greatest(x, y) - least(x, y)) AS m
  FROM g
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN least(x, y) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN greatest(x, y) - least(x, y) END AS middle_chars,
  sha256(CASE form
    WHEN 'plain' THEN t
    WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
    ELSE '<P>' || p || '<S>' || s || '<M>' || m
  END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
"""


def statements() -> dict[str, str]:
    return {
        "op1_warc": OP1_SQL,
        "op11_lexical_search": OP11_SQL,
        "op13_fill_middle": OP13_SQL,
    }
