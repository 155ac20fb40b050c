"""DuckDB statements that compute the registered queries independently of Spark."""

from __future__ import annotations

from kurzwerk import params as P
from kurzwerk.checks.queries import ARTICLE_CHARS, MAX, MODEL_TOKENS, OVERLAP, UPLOAD_PARAMS
from kurzwerk.checks.stems import stem_ctes
from kurzwerk.operators.summarize import EXTRACTIVE

SPACE = "(chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ')"


def strip(x: str) -> str:
    return f"trim({x}, {SPACE})"


def clean(x: str) -> str:
    x = f"replace({x}, chr(13), ' ')"
    x = rf"regexp_replace({x}, '-\n([a-zäöüß])', '\1', 'g')"
    x = rf"regexp_replace({x}, '\n+', ' ', 'g')"
    x = rf"regexp_replace({x}, '[ \t]{{2,}}', ' ', 'g')"
    return strip(x)


def dirty(x: str) -> str:
    x = f"replace({x}, chr(10), chr(13)||chr(10))"
    x = rf"regexp_replace({x}, '([a-zäöüß]{{5}})([a-zäöüß]{{5}})', '\1-' || chr(10) || '\2', 'g')"
    return f"replace({x}, '. ', '.' || chr(9) || ' ')"


def words(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def units(x: str) -> str:
    return f"regexp_extract_all({x}, '[^ ]+')"


def first_units(x: str, n: int) -> str:
    return (
        f"CASE WHEN len({units(x)}) <= {n} THEN {x} "
        f"ELSE array_to_string({units(x)}[1:{n}], ' ') END"
    )


def sentences(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31))"


def rounded(x: str, digits: int) -> str:
    """Python's rounding, by the exact product of ``x`` and the power of ten."""
    s = f"{10**digits}::DOUBLE"
    big = f"(({x}) * 134217729::DOUBLE)"
    high = f"({big} - ({big} - ({x})))"
    low = f"(({x}) - {high})"
    p = f"(({x}) * {s})"
    err = f"(({high} * {s} - {p}) + {low} * {s})"
    f = f"floor({p})"
    return (
        f"(CASE WHEN {p} - {f} < 0.5 THEN {f} WHEN {p} - {f} > 0.5 THEN {f} + 1 "
        f"WHEN {err} > 0 THEN {f} + 1 WHEN {err} < 0 THEN {f} "
        f"WHEN {f} % 2 = 0 THEN {f} ELSE {f} + 1 END / {s})"
    )


CLEANED = f"src AS (SELECT doc_id, {clean('text')} AS text FROM documents)"


def chunk_ctes(limit: int, overlap: int) -> str:
    """``chunks(doc_id, chunk_no, chunk)`` from ``src(doc_id, text)``, sentence by sentence."""
    return f"""
counted AS (
  SELECT doc_id, text, s, list_transform(s, lambda x: len({units('x')})) AS n,
         len({units('text')}) AS total
  FROM (SELECT doc_id, text, {sentences('text')} AS s FROM src)
),
steps AS (
  SELECT doc_id, 0::BIGINT AS k, []::BIGINT[] AS buffer, NULL::BIGINT[] AS packed,
         NULL::BIGINT AS hard
  FROM counted WHERE total > {limit}
  UNION ALL
  SELECT doc_id, k,
         CASE WHEN nk > {limit} THEN kept ELSE list_append(kept, k) END,
         CASE WHEN full_buffer THEN buffer END,
         CASE WHEN nk > {limit} THEN k END
  FROM (
    SELECT *, CASE WHEN NOT full_buffer THEN buffer ELSE list_filter(buffer,
        lambda j: list_sum(list_transform(list_filter(buffer, lambda i: i >= j),
                                          lambda i: n[i])) <= {overlap}) END AS kept
    FROM (
      SELECT r.doc_id, r.k + 1 AS k, c.n AS n, c.n[r.k + 1] AS nk, r.buffer,
             len(r.buffer) > 0 AND c.n[r.k + 1]
               + list_sum(list_transform(r.buffer, lambda i: c.n[i])) > {limit} AS full_buffer
      FROM steps r JOIN counted c ON c.doc_id = r.doc_id
      WHERE r.k < len(c.n)
    )
  )
),
pieces AS (
  SELECT doc_id, 0 AS k, 0 AS phase, 0 AS part, text AS chunk FROM counted WHERE total <= {limit}
  UNION ALL
  SELECT r.doc_id, r.k, 0, 0, array_to_string(list_transform(r.packed, lambda i: c.s[i]), ' ')
  FROM steps r JOIN counted c ON c.doc_id = r.doc_id WHERE r.packed IS NOT NULL
  UNION ALL
  SELECT doc_id, k, 1, part, array_to_string(u[part * {limit} + 1 : (part + 1) * {limit}], ' ')
  FROM (SELECT doc_id, k, u, unnest(range(0, (len(u) + {limit} - 1) // {limit})) AS part
        FROM (SELECT r.doc_id, r.k, {units('c.s[r.k]')} AS u
              FROM steps r JOIN counted c ON c.doc_id = r.doc_id WHERE r.hard IS NOT NULL))
  UNION ALL
  SELECT r.doc_id, r.k + 1, 0, 0, array_to_string(list_transform(r.buffer, lambda i: c.s[i]), ' ')
  FROM steps r JOIN counted c ON c.doc_id = r.doc_id
  WHERE r.k = len(c.n) AND len(r.buffer) > 0
),
chunks AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, phase, part) - 1 AS chunk_no,
         chunk
  FROM (SELECT p.doc_id, p.k, p.phase, p.part,
               CASE WHEN c.total <= {limit} THEN p.chunk ELSE {strip('p.chunk')} END AS chunk,
               c.total
        FROM pieces p JOIN counted c ON c.doc_id = p.doc_id)
  WHERE total <= {limit} OR chunk <> ''
)"""


def summary_ctes(most: int, least: int, source: str = "chunks") -> str:
    """``partials(doc_id, chunk_no, chunk, summary)`` from ``chunks``."""
    return f"""
sents AS (
  SELECT doc_id, chunk_no, sent_no, s[sent_no] AS sentence, {words('s[sent_no]')} AS toks
  FROM (SELECT doc_id, chunk_no, s, unnest(range(1, len(s) + 1)) AS sent_no
        FROM (SELECT doc_id, chunk_no, {sentences('chunk')} AS s
              FROM {source}))
),
toks AS (SELECT doc_id, chunk_no, sent_no, unnest(toks) AS token FROM sents),
tf AS (SELECT doc_id, chunk_no, token, count(*) AS tf FROM toks GROUP BY ALL),
scored AS (
  SELECT doc_id, chunk_no, sent_no, count(*) AS n, sum(tf)::DOUBLE / count(*)::DOUBLE AS score
  FROM toks JOIN tf USING (doc_id, chunk_no, token) GROUP BY ALL
),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id, chunk_no ORDER BY score DESC, sent_no
                         ROWS UNBOUNDED PRECEDING) AS run
  FROM scored
),
picked AS (
  SELECT doc_id, chunk_no, string_agg(sentence, ' ' ORDER BY sent_no) AS summary
  FROM ranked JOIN sents USING (doc_id, chunk_no, sent_no)
  WHERE run <= {most} OR run - n < {least} GROUP BY ALL
),
partials AS (
  SELECT doc_id, chunk_no, chunk, {first_units("coalesce(summary, '')", most)} AS summary
  FROM {source} LEFT JOIN picked USING (doc_id, chunk_no)
)"""


MERGED = f"""
results AS (
  SELECT doc_id, chunk_no, chunk, summary, '{EXTRACTIVE}' AS model_name, NULL::VARCHAR AS error,
    false AS truncated
  FROM partials
)"""

DOCS = f"""
docs AS (
  SELECT doc_id,
    CASE WHEN count(error) = 0 THEN
      {strip("string_agg(" + strip("coalesce(summary, '')") + ", ' ' ORDER BY chunk_no)")} END
      AS summary,
    coalesce(arg_max(model_name, chunk_no) FILTER (WHERE model_name IS NOT NULL), 'unknown')
      AS model_name,
    count(*) AS n_chunks, count(error) AS n_failed,
    arg_min(error, chunk_no) FILTER (WHERE error IS NOT NULL) AS error,
    bool_or(truncated) AS truncated,
    sum(length(chunk))::BIGINT AS input_characters,
    string_agg(chunk, ' ' ORDER BY chunk_no) AS source
  FROM results GROUP BY doc_id
)"""


def covered(source: str, summary: str) -> str:
    return (
        f"len(list_filter({words(summary)}, "
        f"lambda w: contains(array_to_string({words(source)}, ' '), w)))"
    )


def share(a: str, b: str, digits: int) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE {rounded(f'({a}::DOUBLE / {b}::DOUBLE)', digits)} END"


RECORD = f"""
SELECT *, CASE WHEN extractive_coverage IS NOT NULL
  THEN printf('%.0f %%', extractive_coverage * 100) END AS coverage_text FROM (
  SELECT *, {share('covered_words', 'summary_words', 2)} AS extractive_coverage,
         {share('summary_characters', 'input_characters', 3)} AS compression_rate
  FROM (
    SELECT doc_id, CASE WHEN n_failed > 0 THEN 'failed' ELSE 'success' END AS status,
      CASE WHEN n_failed > 0 THEN '{P.MSG_SERVICE_PREFIX + P.MSG_SERVICE_DOWN}' END AS message,
      error, truncated, summary, model_name, input_characters, length(summary) AS summary_characters, n_chunks,
      {covered('source', 'summary')} AS covered_words,
      len({words('summary')}) AS summary_words
    FROM docs
  )
)"""


def report_sql(limit: int, overlap: int, most: int, least: int) -> str:
    return (
        f"WITH RECURSIVE {CLEANED}, {chunk_ctes(limit, overlap)}, {summary_ctes(most, least)}, "
        f"{MERGED}, {DOCS} {RECORD}"
    )


PAGES = """
page_rows AS (
  SELECT conv_id AS doc_id, turn AS page_no,
         CASE WHEN role <> 'system' THEN text END AS text
  FROM conversations
)"""

ASSEMBLED = f"""
assembled AS (
  SELECT doc_id, {strip("string_agg(coalesce(text, ''), chr(10) ORDER BY page_no)")} AS text,
         count(*) AS num_pages, count(*) - count(text) AS n_page_errors
  FROM page_rows GROUP BY doc_id
)"""

UPLOADS = r"""
uploads AS (
  SELECT doc_id,
    'doc_' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' ELSE '.pdf' END
      AS filename,
    CASE WHEN doc_id % 31 <> 0 THEN
      'data:application/pdf;base64' || CASE WHEN doc_id % 17 = 0 THEN '' ELSE ',' END ||
      CASE WHEN doc_id % 19 = 0 THEN '' WHEN doc_id % 23 = 0 THEN '//5B'
           WHEN doc_id % 29 = 0 THEN to_base64(encode(' ' || chr(10) || chr(9) || ' '))
           ELSE to_base64(encode(text)) END END AS contents
  FROM documents
),
decoded AS (
  SELECT doc_id, filename,
    CASE WHEN contains(contents, ',')
         THEN from_base64(substr(contents, position(',' IN contents) + 1)) END AS content
  FROM uploads WHERE contents IS NOT NULL AND filename IS NOT NULL
)"""

LATE = f"""
late AS (
  SELECT doc_id, filename, CASE WHEN reason IS NULL THEN {strip('body')} END AS body, reason,
         CASE WHEN reason IS NULL AND body IS NOT NULL
              THEN len(string_split(body, chr(10))) END AS num_pages,
         reason IS NULL AND body IS NULL AS broken
  FROM (
    SELECT *, CASE WHEN reason IS NULL THEN TRY(decode(content)) END AS body
    FROM (
      SELECT *, CASE WHEN content IS NULL THEN 'undecodable'
                     WHEN NOT lower(filename) LIKE '%.pdf' THEN 'extension'
                     WHEN octet_length(content) = 0 THEN 'empty'
                     WHEN octet_length(content) > {UPLOAD_PARAMS.max_file_size} THEN 'oversize'
                END AS reason
      FROM decoded
    )
  )
)"""


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def filled(template: str, *values: str) -> str:
    parts = template.split("%s")
    out = sql_text(parts[0])
    for value, part in zip(values, parts[1:]):
        out += f" || {value} || {sql_text(part)}"
    return out


def outcome_sql(source: str, keys: str, extra: str = "") -> str:
    """Outcome columns from ``filename, reason, body, num_pages``."""
    p = UPLOAD_PARAMS
    invalid = sql_text(P.MSG_INVALID_PREFIX)
    return f"""
SELECT {keys}, CASE WHEN reason IS NULL THEN 'success' WHEN reason = 'page_cap' THEN 'warning'
                    ELSE 'error' END AS status,
  reason,
  CASE reason
    WHEN 'undecodable' THEN {invalid} || {sql_text(P.MSG_UNDECODABLE)}
    WHEN 'extension' THEN {invalid} || {filled(P.MSG_EXTENSION, 'filename')}
    WHEN 'empty' THEN {invalid} || {sql_text(P.MSG_EMPTY)}
    WHEN 'oversize' THEN {invalid} || {sql_text(P.MSG_OVERSIZE % p.size_limit_text)}
    WHEN 'unreadable' THEN {sql_text(P.MSG_ERROR_PREFIX + P.MSG_UNREADABLE)}
    WHEN 'no_text' THEN {sql_text(P.MSG_ERROR_PREFIX + P.MSG_NO_TEXT)}
    WHEN 'page_cap' THEN {filled(P.MSG_PAGE_CAP, 'num_pages', str(p.max_pages))}
    ELSE {filled(P.MSG_SUCCESS, 'filename', 'num_pages', 'length(body)')} END AS message,
  CASE WHEN reason IS NULL THEN {clean('body')} END AS text,
  num_pages, {extra} reason IS NULL AS ready
FROM ({source})"""


CLASSIFIED = f"""WITH {UPLOADS}, {LATE}
{outcome_sql(f'''SELECT doc_id, filename, body, num_pages,
  CASE WHEN reason IS NOT NULL THEN reason WHEN broken THEN 'unreadable'
       WHEN body = '' THEN 'no_text' WHEN num_pages > {UPLOAD_PARAMS.max_pages} THEN 'page_cap'
  END AS reason FROM late''', 'doc_id, filename', 'length(body) AS num_characters,')}"""

CLASSIFIED_PAGES = f"""WITH {PAGES}, {ASSEMBLED}
{outcome_sql(f'''SELECT doc_id, doc_id::VARCHAR AS filename,
  text AS body, num_pages, n_page_errors,
  CASE WHEN text = '' THEN 'no_text' WHEN num_pages > {UPLOAD_PARAMS.max_pages} THEN 'page_cap'
  END AS reason FROM assembled''', 'doc_id', 'length(body) AS num_characters, n_page_errors,')}"""

TURN_PAIRS = """
pairs AS (
  SELECT u.conv_id || '-' || u.turn AS pair_id, u.text AS reference, a.text AS candidate
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
)"""

ROUGE_TOKENS = """
tokens AS (
  SELECT pair_id, regexp_extract_all(lower(reference), '[a-z0-9]+') AS r,
         regexp_extract_all(lower(candidate), '[a-z0-9]+') AS c
  FROM pairs
)"""


def stemmed_side(side: str) -> str:
    return f"""
stemmed_{side} AS (
  SELECT pair_id, list(w ORDER BY i) AS {side}
  FROM (SELECT pair_id, unnest({side}) AS word, unnest(range(len({side}))) AS i FROM plain_tokens)
  JOIN stems USING (word) GROUP BY pair_id
)"""


STEMMED_TOKENS = f"""
{ROUGE_TOKENS.replace('tokens AS', 'plain_tokens AS', 1)},
vocabulary AS (
  SELECT unnest(r) AS word FROM plain_tokens UNION SELECT unnest(c) FROM plain_tokens
),
{stem_ctes('vocabulary')}, {stemmed_side('r')}, {stemmed_side('c')},
tokens AS (
  SELECT pair_id, coalesce(a.r, []) AS r, coalesce(b.c, []) AS c
  FROM pairs LEFT JOIN stemmed_r a USING (pair_id) LEFT JOIN stemmed_c b USING (pair_id)
)"""


def gram_ctes(n: int) -> str:
    """``overlap{n}(pair_id, overlap, reference, candidate)``."""

    def grams(side: str) -> str:
        return (
            f"SELECT pair_id, array_to_string({side}[i : i + {n - 1}], ' ') AS gram "
            f"FROM (SELECT pair_id, {side}, unnest(range(1, len({side}) - {n} + 2)) AS i FROM tokens)"
        )

    return f"""
overlap{n} AS (
  SELECT t.pair_id, coalesce(hits, 0)::BIGINT AS overlap,
         greatest(len(r) - {n - 1}, 0) AS reference, greatest(len(c) - {n - 1}, 0) AS candidate
  FROM tokens t LEFT JOIN (
    SELECT a.pair_id, sum(least(a.k, b.k)) AS hits
    FROM (SELECT pair_id, gram, count(*) AS k FROM ({grams('r')}) GROUP BY ALL) a
    JOIN (SELECT pair_id, gram, count(*) AS k FROM ({grams('c')}) GROUP BY ALL) b
      ON a.pair_id = b.pair_id AND a.gram = b.gram
    GROUP BY a.pair_id) h ON h.pair_id = t.pair_id
)"""


# One table row per position of the reference; every round reads one candidate token.
LCS = """
ref_rows AS (
  SELECT pair_id, unnest(range(1, len(r) + 1)) AS j, unnest(r) AS token FROM tokens
),
cand_rows AS (
  SELECT pair_id, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS token FROM tokens
),
lcs_rows AS (
  SELECT pair_id, 0::BIGINT AS i, j, token, 0::BIGINT AS v FROM ref_rows
  UNION ALL
  SELECT pair_id, i, j, token, max(CASE WHEN hit THEN before + 1 ELSE v END)
                          OVER (PARTITION BY pair_id ORDER BY j ROWS UNBOUNDED PRECEDING)
  FROM (
    SELECT l.pair_id, c.i, l.j, l.token, l.v, l.token = c.token AS hit,
           lag(l.v, 1, 0) OVER (PARTITION BY l.pair_id ORDER BY l.j) AS before
    FROM lcs_rows l JOIN cand_rows c ON c.pair_id = l.pair_id AND c.i = l.i + 1
  )
),
overlapL AS (
  SELECT t.pair_id, coalesce(v, 0)::BIGINT AS overlap, len(r) AS reference, len(c) AS candidate
  FROM tokens t LEFT JOIN (SELECT pair_id, max(v) AS v FROM lcs_rows GROUP BY pair_id) l
    ON l.pair_id = t.pair_id
)"""


def prf(source: str, name: str) -> str:
    return f"""
SELECT pair_id, overlap AS {name}_overlap, reference AS {name}_reference,
       candidate AS {name}_candidate, p AS {name}_p, r AS {name}_r,
       CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS {name}_f
FROM (SELECT *, CASE WHEN candidate > 0 THEN overlap::DOUBLE / candidate ELSE 0.0 END AS p,
             CASE WHEN reference > 0 THEN overlap::DOUBLE / reference ELSE 0.0 END AS r
      FROM {source})"""


ARTICLE_PARTIALS = f"""
cuts AS (SELECT doc_id, 0 AS chunk_no, text AS chunk FROM articles),
{summary_ctes(180, 30, 'cuts')}"""

HOOK_PARTIALS = f"""
cuts AS (SELECT doc_id, {first_units('text', 1022)} AS chunk FROM articles),
partials AS (
  SELECT doc_id, array_to_string(string_split(chunk, ' ')[1:12], ' ') || ' ' AS summary
  FROM cuts WHERE NOT contains(chunk, 'Z')
)"""


def detail_ctes(partials: str = ARTICLE_PARTIALS) -> str:
    lead = f"array_to_string(({sentences(clean('text'))})[1:3], ' ')"
    return f"""
articles AS (SELECT doc_id, text, {lead} AS reference FROM documents),
{partials},
pairs AS (
  SELECT doc_id AS pair_id, reference, summary AS candidate
  FROM articles JOIN partials USING (doc_id)
),
{ROUGE_TOKENS}, {gram_ctes(1)}, {gram_ctes(2)}, {LCS},
detail AS (
  SELECT a.doc_id AS example_id, rouge1_f, rouge2_f, rougeL_f,
    CASE WHEN length(a.text) > 0 THEN length(s.summary)::DOUBLE / length(a.text) ELSE 0.0 END
      AS compression_rate,
    length(a.text) AS input_characters, length(s.summary) AS summary_characters
  FROM articles a JOIN partials s USING (doc_id)
  JOIN ({prf('overlap1', 'rouge1')}) x1 ON x1.pair_id = a.doc_id
  JOIN ({prf('overlap2', 'rouge2')}) x2 ON x2.pair_id = a.doc_id
  JOIN ({prf('overlapL', 'rougeL')}) xl ON xl.pair_id = a.doc_id
)"""


REPORT = f"""WITH RECURSIVE {detail_ctes()}
SELECT '{EXTRACTIVE}' AS model_name, 'documents' AS dataset, num_samples,
  {rounded('r1', 4)} AS rouge1_f_mean, {rounded('r2', 4)} AS rouge2_f_mean,
  {rounded('rl', 4)} AS rougeL_f_mean, {rounded('chars', 2)} AS input_characters_mean,
  {rounded('p95', 2)} AS input_characters_p95, {rounded('rate', 4)} AS compression_rate_mean
FROM (SELECT count(*) AS num_samples, avg(rouge1_f) AS r1, avg(rouge2_f) AS r2,
             avg(rougeL_f) AS rl, avg(input_characters) AS chars,
             quantile_cont(input_characters::DOUBLE, 0.95) AS p95, avg(compression_rate) AS rate
      FROM detail)"""

CHUNKED = f"WITH RECURSIVE {CLEANED}, {chunk_ctes(MAX, OVERLAP)}"

TURN_RESULTS = """
results AS (
  SELECT conv_id AS doc_id, turn AS chunk_no, text AS chunk,
    ' ' || string_split(text, '.')[1] AS summary,
    CASE WHEN role <> 'system' THEN role END AS model_name,
    CASE WHEN length(text) % 7 = 3 THEN 'refused' END AS error, false AS truncated
  FROM conversations
)"""

STAND_IN = f"""
results AS (
  SELECT doc_id, chunk_no, chunk, truncated,
    CASE WHEN NOT contains(seen, 'Z') THEN
      array_to_string(string_split(seen, ' ')[1:12], ' ') || ' ' END AS summary,
    CASE WHEN NOT contains(seen, 'Z') THEN 'first-words' END AS model_name,
    CASE WHEN contains(seen, 'Z') THEN '{P.MSG_MODEL_FAILED} ValueError: refused' END AS error
  FROM (SELECT *, {first_units('chunk', MODEL_TOKENS - 2)} AS seen,
               len({units('chunk')}) + 2 >= {MODEL_TOKENS} AS truncated FROM chunks)
)"""

HOOK_REPORT = f"""WITH RECURSIVE {detail_ctes(HOOK_PARTIALS)}
SELECT 'first-words' AS model_name, 'documents' AS dataset, num_samples,
  (SELECT count(*) FROM documents) - num_samples AS n_failed,
  {rounded('r1', 4)} AS rouge1_f_mean, {rounded('r2', 4)} AS rouge2_f_mean,
  {rounded('rl', 4)} AS rougeL_f_mean, {rounded('rate', 4)} AS compression_rate_mean
FROM (SELECT count(*) AS num_samples, avg(rouge1_f) AS r1, avg(rouge2_f) AS r2,
             avg(rougeL_f) AS rl, avg(compression_rate) AS rate FROM detail)"""


def statements() -> dict[str, str]:
    cut = units("text")
    return {
        "clean_text": f"""
SELECT doc_id, clean, length(clean) AS n_chars
FROM (SELECT doc_id, {clean(dirty('text'))} AS clean FROM documents)""",
        "clean_text_raw": f"WITH {CLEANED} SELECT doc_id, text, length(text) AS n_chars FROM src",
        "word_tokens": f"""
SELECT doc_id, unnest(range(0, len(t))) AS pos, unnest(t) AS token
FROM (SELECT doc_id, {words('text')} AS t FROM documents)""",
        "sentences": f"""
WITH {CLEANED}
SELECT doc_id, sent_no, sentence, len({units('sentence')}) AS n_tokens
FROM (SELECT doc_id, unnest(range(0, len(s))) AS sent_no, unnest(s) AS sentence
      FROM (SELECT doc_id, {sentences('text')} AS s FROM src))""",
        "truncate_tokens": f"""
WITH {CLEANED}
SELECT doc_id, {first_units('text', 1022)} AS text, len({cut}) + 2 >= 1024 AS truncated FROM src""",
        "truncate_chars": f"SELECT doc_id, substr(text, 1, {ARTICLE_CHARS}) AS article FROM documents",
        "chunk_text": f"""{CHUNKED}
SELECT doc_id, chunk_no, chunk, length(chunk) AS n_chars FROM chunks""",
        "chunk_text_default": f"""
WITH RECURSIVE {CLEANED}, {chunk_ctes(900, 50)}
SELECT doc_id, chunk_no, chunk, length(chunk) AS n_chars FROM chunks""",
        "chunk_counts": f"""{CHUNKED}
SELECT doc_id, count(*) AS n_chunks, sum(length(chunk))::BIGINT AS input_characters
FROM chunks GROUP BY doc_id""",
        "window_report": f"""{CHUNKED}
SELECT n_chunks, count(*) AS n_documents, sum(chars)::BIGINT AS input_characters
FROM (SELECT doc_id, count(*) AS n_chunks, sum(length(chunk)) AS chars
      FROM chunks GROUP BY doc_id)
GROUP BY n_chunks""",
        "decode_upload": f"""
WITH {UPLOADS}
SELECT doc_id, content IS NOT NULL AS decodable, octet_length(content) AS size,
       hex(content) AS content_hex
FROM decoded""",
        "classify_upload": CLASSIFIED,
        "quarantine": f"""
SELECT status, reason, count(*) AS n_uploads FROM ({CLASSIFIED})
WHERE status <> 'success' GROUP BY ALL""",
        "extract_hook": CLASSIFIED,
        "incremental_intake": CLASSIFIED,
        "assemble_pages": f"""
WITH {PAGES}, {ASSEMBLED}
SELECT doc_id, text, num_pages, length(text) AS num_characters, n_page_errors,
       text <> '' AS has_text
FROM assembled""",
        "classify_pages": CLASSIFIED_PAGES,
        "incremental_pages": CLASSIFIED_PAGES,
        "non_empty": """
SELECT conv_id, turn FROM conversations WHERE role <> 'system' AND length(text) >= 1""",
        "summarize_chunks": f"""{CHUNKED}, {summary_ctes(40, 10)}
SELECT doc_id, chunk_no, summary, '{EXTRACTIVE}' AS model_name FROM partials""",
        "merge_summaries": f"""
WITH {TURN_RESULTS}, {DOCS}
SELECT doc_id, summary, model_name, n_chunks, n_failed, error, truncated, input_characters
FROM docs""",
        "document_record": f"WITH {TURN_RESULTS}, {DOCS} {RECORD}",
        "compression": f"""{CHUNKED}, {summary_ctes(40, 10)}, {MERGED}, {DOCS}
SELECT *, {share('summary_characters', 'input_characters', 3)} AS compression_rate
FROM (SELECT doc_id, input_characters, length(summary) AS summary_characters,
             CASE WHEN input_characters = 0 THEN 0.0
                  ELSE length(summary)::DOUBLE / input_characters END AS ratio FROM docs)""",
        "coverage": f"""
WITH {TURN_PAIRS}
SELECT *, {share('covered', 'n_words', 2)} AS coverage
FROM (SELECT pair_id, {covered('candidate', 'reference')} AS covered,
             len({words('reference')}) AS n_words FROM pairs)""",
        "document_report": report_sql(900, 50, 150, 30),
        "document_report_small_window": report_sql(MAX, OVERLAP, 40, 10),
        "map_summarizer": f"{CHUNKED}, {STAND_IN}, {DOCS} {RECORD}",
        "rouge1": f"WITH {TURN_PAIRS}, {ROUGE_TOKENS}, {gram_ctes(1)} {prf('overlap1', 'rouge1')}",
        "rouge2": f"WITH {TURN_PAIRS}, {ROUGE_TOKENS}, {gram_ctes(2)} {prf('overlap2', 'rouge2')}",
        "rouge_l": f"WITH RECURSIVE {TURN_PAIRS}, {ROUGE_TOKENS}, {LCS} {prf('overlapL', 'rougeL')}",
        "rouge_stemmed": f"""
WITH RECURSIVE {TURN_PAIRS}, {STEMMED_TOKENS}, {gram_ctes(1)}, {gram_ctes(2)}, {LCS}
SELECT * FROM ({prf('overlap1', 'rouge1')}) JOIN ({prf('overlap2', 'rouge2')}) USING (pair_id)
JOIN ({prf('overlapL', 'rougeL')}) USING (pair_id)""",
        "eval_detail": f"WITH RECURSIVE {detail_ctes()} SELECT * FROM detail",
        "detail_csv": f"WITH RECURSIVE {detail_ctes()} SELECT * FROM detail",
        "eval_report": REPORT,
        "eval_hook": HOOK_REPORT,
        "report_json": REPORT,
        "quantile": """
SELECT round(quantile_cont(n_chars::DOUBLE, 0.95), 6) AS n_chars_p95 FROM documents""",
        "sample_articles": "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 30",
    }
