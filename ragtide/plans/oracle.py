"""DuckDB SQL for every query in ``plans.catalog`` that SQL can express.

Tables are the pre-registered views of the test parquet files.  Column names
and rounding match the Spark side exactly.
"""

from __future__ import annotations

from ragtide.functions.text import PY_WS
from ragtide.operators.embed import EMBEDDING_DIM
from ragtide.plans import catalog as C

WS = "(" + " || ".join(f"chr({ord(ch)})" for ch in PY_WS) + ")"
NL = "chr(10)"


def _iso(ts: str) -> str:
    return (f"CASE WHEN epoch_us({ts}) % 1000000 = 0 THEN strftime({ts}, '%Y-%m-%dT%H:%M:%S') "
            f"ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') END")


def _preview(t: str, n: int) -> str:
    return f"CASE WHEN length({t}) > {n} THEN substring({t}, 1, {n}) || '...' ELSE {t} END"


DOCS = f"""docs AS (
  SELECT doc_id, source AS file, text AS content, lang AS type,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS created_at
  FROM documents)"""

CHUNKS = f"""chunks AS (
  SELECT d.doc_id, d.file, d.type, d.created_at, t.i AS chunk_index,
         substring(d.s, t.i * 500 + 1, 500) AS corpus
  FROM (SELECT *, trim(content, {WS}) AS s FROM docs) d,
       unnest(generate_series(0, (length(d.s) - 1) // 500)) AS t(i)
  WHERE length(d.s) > 0)"""

CORPUS = f"""corpus AS (
  SELECT row_number() OVER (ORDER BY doc_id, chunk_index) AS id, corpus, file AS file_name,
         type AS file_type, created_at, doc_id, chunk_index
  FROM chunks WHERE trim(corpus, {WS}) <> '')"""

WITH_CORPUS = f"WITH {DOCS},\n{CHUNKS},\n{CORPUS}\n"

VEC = "vec AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"


def _cos(a: str, b: str) -> str:
    return (f"CASE WHEN list_dot_product({a}, {a}) = 0 OR list_dot_product({b}, {b}) = 0 THEN 0.0 "
            f"ELSE list_cosine_similarity({a}, {b}) END")


def _length_hist(labels) -> str:
    b = [50, 100, 200, 500]
    case = "CASE " + " ".join(f"WHEN length(corpus) < {x} THEN '{l}'" for x, l in zip(b, labels)) \
        + f" ELSE '{labels[-1]}' END"
    return WITH_CORPUS + f"""SELECT {case} AS category, count(*) AS count, min(length(corpus)) AS min_length
FROM corpus GROUP BY 1 ORDER BY min_length"""


RAG = f"""{DOCS},
{CHUNKS},
{CORPUS},
{VEC},
placed AS (SELECT e, row_number() OVER (ORDER BY vec_id) - 1 AS place, count(*) OVER () AS n FROM vec),
rag AS (SELECT c.id, v.e, c.corpus FROM corpus c JOIN placed v ON (c.id - 1) % v.n = v.place),
req AS (SELECT item_id AS qid, coalesce(text, '') AS question FROM benchmark),
reqv AS (SELECT r.qid, r.question, v.e FROM req r JOIN placed v ON r.qid % v.n = v.place WHERE r.question <> '')"""


def _rag_hits(k: int) -> str:
    return RAG + f""",
scored AS (SELECT q.qid, c.id, {_cos('c.e', 'q.e')} AS sim FROM reqv q, rag c),
hits AS (SELECT * FROM (SELECT qid, id, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank
                        FROM scored) WHERE rank <= {k})
"""


HISTORY = """hist AS (
  SELECT u.conv_id AS session_id, u.turn AS seq, u.text AS query, a.text AS answer,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(u.conv_id) + to_seconds(u.turn) AS ts
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def _history_last(n: int) -> str:
    return f"""WITH {HISTORY},
ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS rn,
                  count(*) OVER (PARTITION BY session_id) AS count FROM hist)
SELECT session_id, least(count, {n}) - rn + 1 AS position, seq, query, answer, {_iso('ts')} AS timestamp, count
FROM ranked WHERE rn <= {n}"""


def _pages_assembled(marked: bool) -> str:
    body = f"'--- Page ' || page_no::VARCHAR || ' ---' || {NL} || text || {NL}" if marked else "text"
    return f"""WITH {DOCS},
pages AS (SELECT d.doc_id AS file, t.page_no, t.text
          FROM docs d, unnest(string_split(d.content, {NL})) WITH ORDINALITY AS t(text, page_no)),
kept AS (SELECT file, page_no, {body} AS body FROM pages WHERE trim(text, {WS}) <> '')
SELECT file, string_agg(body, {NL} ORDER BY page_no) AS text, count(*) AS n_pages,
       length(string_agg(body, {NL} ORDER BY page_no)) AS characters
FROM kept GROUP BY file"""


SQL: dict[str, str] = {
    "topk_cosine": f"""WITH {VEC},
q AS (SELECT e FROM vec WHERE vec_id = {C.QUERY_VECTOR_ID}),
s AS (SELECT v.vec_id, {_cos('v.e', 'q.e')} AS sim FROM vec v, q)
SELECT row_number() OVER (ORDER BY sim DESC, vec_id) AS rank, vec_id, round(sim, 6) AS similarity,
       round(1 - sim, 6) AS distance, (round(sim * 100, 1) + 0.0) AS relevance
FROM s ORDER BY sim DESC, vec_id LIMIT {C.TOP_K}""",

    "topk_batch": f"""WITH {VEC},
s AS (SELECT q.vec_id AS qid, c.vec_id, {_cos('c.e', 'q.e')} AS sim FROM vec q, vec c),
r AS (SELECT qid, vec_id, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS rank FROM s)
SELECT qid, rank, vec_id, round(sim, 6) AS similarity FROM r WHERE rank <= {C.TOP_K}""",

    "topk_l2": f"""WITH {VEC},
s AS (SELECT q.vec_id AS qid, c.vec_id, list_distance(c.e, q.e) AS d FROM vec q, vec c),
r AS (SELECT qid, vec_id, d, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rank FROM s)
SELECT qid, rank, vec_id, round(d, 6) AS distance FROM r WHERE rank <= {C.TOP_K}""",

    "cosine_scores": f"""WITH {VEC},
q AS (SELECT e FROM vec WHERE vec_id = {C.QUERY_VECTOR_ID}),
s AS (SELECT v.vec_id, {_cos('v.e', 'q.e')} AS sim, list_distance(v.e, q.e) AS l2 FROM vec v, q)
SELECT vec_id, round(sim, 6) AS similarity, round(1 - sim, 6) AS distance, (round(sim * 100, 1) + 0.0) AS relevance,
       round(l2, 6) AS l2_distance FROM s""",

    "parse_vector_roundtrip": f"""WITH {VEC},
t AS (SELECT vec_id, '[' || array_to_string(list_transform(e, lambda x: x::VARCHAR), ',') || ']' AS b,
             '{{' || array_to_string(list_transform(e, lambda x: x::VARCHAR), ',') || '}}' AS c FROM vec),
p AS (SELECT vec_id,
             list_transform(string_split(trim(b, '[]'), ','), lambda x: TRY_CAST(trim(x) AS DOUBLE)) AS pb,
             list_transform(string_split(trim(c, '{{}}'), ','), lambda x: TRY_CAST(trim(x) AS DOUBLE)) AS pc FROM t)
SELECT vec_id, len(pb) AS dim, round(list_sum(pb), 6) AS sum_bracket, round(list_sum(pc), 6) AS sum_brace,
       (len(pb) > 0 AND list_bool_and(list_transform(pb, lambda x: x IS NOT NULL))) AS valid FROM p""",

    "chunk_documents": WITH_CORPUS + """SELECT id, doc_id, chunk_index, corpus, file_name, file_type,
       length(corpus) AS length FROM corpus""",

    "split_utterances": f"""WITH {DOCS},
lines AS (SELECT d.doc_id, t.l, t.line_no FROM docs d,
          unnest(string_split(d.content, {NL})) WITH ORDINALITY AS t(l, line_no))
SELECT doc_id, line_no, CASE WHEN starts_with(l, '     ') THEN substring(l, 6) ELSE l END AS utterance
FROM lines WHERE l <> '' AND NOT starts_with(l, '<')""",

    "corpus_stats": WITH_CORPUS + f"""SELECT count(*) AS total_records,
       coalesce(round(avg(length(corpus)), 2), 0.0) AS avg_length,
       count(DISTINCT file_name) AS unique_files,
       {_iso('min(created_at)')} AS first_created, {_iso('max(created_at)')} AS last_created
FROM corpus""",

    "stats_display": WITH_CORPUS + """SELECT count(*) AS total_records,
       coalesce(round(avg(length(corpus)), 2), 0.0) AS avg_length,
       CAST(floor(coalesce(round(avg(length(corpus)), 2), 0.0) + 0.5) AS BIGINT) AS avg_length_display
FROM corpus""",

    "length_histogram_fr": _length_hist(["Très court (<50)", "Court (50-100)", "Moyen (100-200)",
                                         "Long (200-500)", "Très long (>500)"]),
    "length_histogram_range": _length_hist(["0-50", "50-100", "100-200", "200-500", "500+"]),

    "type_counts": WITH_CORPUS + "SELECT upper(file_type) AS file_type, count(*) AS count FROM corpus GROUP BY file_type",

    "file_distribution": WITH_CORPUS + """, per AS (SELECT file_name, count(*) AS count FROM corpus GROUP BY file_name),
tot AS (SELECT count(*) AS t, count(DISTINCT file_name) AS f FROM corpus)
SELECT file_name, count, CASE WHEN f > 0 THEN t // f ELSE 0 END AS estimated_count
FROM per, tot ORDER BY count DESC, file_name LIMIT 10""",

    "ingest_summary": WITH_CORPUS + f""", d AS (SELECT type AS file_type, count(*) AS documents FROM docs
           WHERE trim(content, {WS}) <> '' GROUP BY type),
c AS (SELECT file_type, count(*) AS chunks FROM corpus GROUP BY file_type)
SELECT coalesce(d.file_type, c.file_type) AS file_type, coalesce(documents, 0) AS documents,
       coalesce(chunks, 0) AS chunks FROM d FULL OUTER JOIN c ON d.file_type = c.file_type""",

    "date_range": WITH_CORPUS + f"""SELECT {_iso('min(created_at)')} AS first, {_iso('max(created_at)')} AS last
FROM corpus""",

    "recent_rows": WITH_CORPUS + f"""SELECT id, {_preview('corpus', 100)} AS text, {_iso('created_at')} AS date
FROM corpus ORDER BY created_at DESC, id DESC LIMIT 5""",

    "table_preview": WITH_CORPUS + f"""SELECT id, {_preview('corpus', 100)} AS corpus, {_iso('created_at')} AS created_at
FROM corpus ORDER BY id LIMIT 10""",

    "keyword_search": WITH_CORPUS + f"""SELECT id, corpus AS text, {_iso('created_at')} AS date, file_name
FROM corpus WHERE corpus ILIKE '%{C.KEYWORD}%' ESCAPE '\\' ORDER BY id LIMIT 10""",

    "keyword_indexed": WITH_CORPUS + f"""SELECT id, corpus AS text, {_iso('created_at')} AS date, file_name
FROM corpus WHERE corpus ILIKE '%{C.INDEXED_KEYWORD}%' ESCAPE '\\' ORDER BY id LIMIT 10""",

    "keyword_count": WITH_CORPUS + f"""SELECT count(*) AS matches FROM corpus
WHERE corpus ILIKE '%{C.KEYWORD}%' ESCAPE '\\'""",

    "keyword_batch": WITH_CORPUS + """, words AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
          FROM benchmark),
kw AS (SELECT w.item_id * 1000000 + t.pos AS qid, t.keyword
       FROM words w, unnest(w.ws) WITH ORDINALITY AS t(keyword, pos)),
m AS (SELECT k.qid, c.id FROM kw k JOIN corpus c ON contains(lower(c.corpus), k.keyword)),
r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id) AS rank,
             count(*) OVER (PARTITION BY qid) AS matches FROM m)
SELECT qid, rank, id, matches FROM r WHERE rank <= 10""",

    "page_assembly": _pages_assembled(False),
    "page_assembly_marked": _pages_assembled(True),

    "page_blocks": f"""WITH {DOCS},
pages AS (SELECT d.doc_id AS file, t.page_no, t.text
          FROM docs d, unnest(string_split(d.content, {NL})) WITH ORDINALITY AS t(text, page_no)),
kept AS (SELECT file, page_no, '--- Page ' || page_no::VARCHAR || ' ---' || {NL} || text || {NL} AS body
         FROM pages WHERE trim(text, {WS}) <> '')
SELECT file, page_no // {C.PAGE_BLOCK} AS block, string_agg(body, {NL} ORDER BY page_no) AS text,
       count(*) AS n_pages
FROM kept GROUP BY file, page_no // {C.PAGE_BLOCK}""",

    "page_summary": f"""WITH {DOCS},
pages AS (SELECT d.doc_id AS file, t.page_no, t.text
          FROM docs d, unnest(string_split(d.content, {NL})) WITH ORDINALITY AS t(text, page_no)),
kept AS (SELECT file, '--- Page ' || page_no::VARCHAR || ' ---' || {NL} || text || {NL} AS body
         FROM pages WHERE trim(text, {WS}) <> ''),
agg AS (SELECT file, count(*) AS pages_kept, length(string_agg(body, {NL})) AS characters FROM kept GROUP BY file),
allp AS (SELECT file, count(*) AS pages FROM pages GROUP BY file)
SELECT a.file, a.pages, coalesce(g.pages_kept, 0) AS pages_kept, coalesce(g.characters, 0) AS characters
FROM allp a LEFT JOIN agg g ON a.file = g.file""",

    "union_documents": f"""WITH u AS (
  SELECT doc_id AS source_id, source AS file, lang AS type, text AS content FROM documents
  UNION ALL
  SELECT page_id AS source_id, url AS file, 'html' AS type, html AS content FROM pages)
SELECT source_id, file, type, trim(content, {WS}) AS content FROM u WHERE trim(content, {WS}) <> ''""",

    "decode_documents": """SELECT doc_id, regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g') AS text FROM documents""",

    "page_files": """WITH p AS (SELECT page_id, url, html, regexp_replace(html, chr(13) || chr(10) || '?', chr(10), 'g') AS t FROM pages)
SELECT page_id, list_extract(string_split(url, '/'), -1) AS name, round(octet_length(encode(html)) / 1024.0, 2) AS size_kb,
       length(t) - length(replace(t, chr(10), '')) + CASE WHEN t = '' OR right(t, 1) = chr(10) THEN 0 ELSE 1 END AS lines
FROM p""",

    "request_normalize": """SELECT item_id AS qid, coalesce(text, '') AS question, CAST(5 AS BIGINT) AS top_k,
       CASE WHEN coalesce(text, '') = '' THEN 'rejected' ELSE 'ok' END AS status,
       CASE WHEN coalesce(text, '') = '' THEN 'Question is required' END AS error
FROM benchmark""",

    "sources": "WITH " + _rag_hits(5) + f"""SELECT h.qid, h.rank, h.id, {_preview('c.corpus', 200)} AS text,
       (round(h.sim * 100, 1) + 0.0) AS relevance FROM hits h JOIN rag c ON c.id = h.id""",

    "context_prompt": "WITH " + _rag_hits(5) + f""", ctx AS (
  SELECT h.qid, string_agg(c.corpus, ' ' ORDER BY h.rank) AS context, count(*) AS sources_count
  FROM hits h JOIN rag c ON c.id = h.id GROUP BY h.qid)
SELECT r.qid, r.question, coalesce(x.sources_count, 0) AS sources_count, coalesce(x.context, '') AS context,
  'Tu es un assistant spécialisé dans l''analyse de conversations universitaires.' || {NL} ||
  'Réponds UNIQUEMENT avec les informations du contexte. Si l''info n''est pas dans le contexte, dis-le clairement.'
  || {NL} || {NL} || 'Contexte: ' || coalesce(x.context, '') || {NL} || {NL} || 'Question: ' || r.question
  || {NL} || {NL} || 'Réponse détaillée et structurée en français:' AS prompt
FROM reqv r LEFT JOIN ctx x ON x.qid = r.qid""",

    "context_prompt_short": "WITH " + _rag_hits(3) + f""", ctx AS (
  SELECT h.qid, string_agg(c.corpus, ' ' ORDER BY h.rank) AS context, count(*) AS sources_count,
         string_agg(substring(c.corpus, 1, 80) || '...', {NL} ORDER BY h.rank) AS source_snippets
  FROM hits h JOIN rag c ON c.id = h.id GROUP BY h.qid)
SELECT r.qid, r.question, coalesce(x.sources_count, 0) AS sources_count,
  'Tu es un assistant spécialisé dans l''analyse de conversations universitaires.' || {NL} ||
  'Réponds UNIQUEMENT avec les informations du contexte. Si l''info n''est pas dans le contexte, dis-le.'
  || {NL} || {NL} || 'Contexte: ' || coalesce(x.context, '') || {NL} || {NL} || 'Question: ' || r.question
  || {NL} || {NL} || 'Réponse courte en français:' AS prompt,
  coalesce(x.source_snippets, '') AS source_snippets
FROM reqv r LEFT JOIN ctx x ON x.qid = r.qid""",

    "semantic_search": "WITH " + _rag_hits(10) + """SELECT h.qid, h.rank, h.id, c.corpus AS text,
       (round(h.sim * 100, 1) + 0.0) AS relevance FROM hits h JOIN rag c ON c.id = h.id""",

    "history_last_n": _history_last(10),
    "history_last_2": _history_last(2),

    "history_clear": f"""WITH {HISTORY}
SELECT session_id, seq, query, answer, {_iso('ts')} AS timestamp FROM hist WHERE session_id <> {C.CLEARED_SESSION}""",
}

for _name in ("corpus_stats", "type_counts", "file_distribution"):
    SQL[f"merged_{_name}"] = SQL[_name]
SQL["merged_length_histogram"] = SQL["length_histogram_fr"]

SQL["history_stored"] = _history_last(10) + f" AND session_id <> {C.CLEARED_SESSION}"

SQL["utterance_ingest"] = f"""WITH u AS ({SQL["split_utterances"]})
SELECT row_number() OVER (ORDER BY doc_id, line_no) AS id, utterance AS corpus, CAST({EMBEDDING_DIM} AS BIGINT) AS dim FROM u"""

SQL["corpus_append"] = WITH_CORPUS + f"""SELECT row_number() OVER (ORDER BY doc_id % 2, doc_id, chunk_index) AS id, corpus,
       lpad(CAST(doc_id AS VARCHAR), 20, '0') AS file_name, 'txt' AS file_type, CAST({EMBEDDING_DIM} AS BIGINT) AS dim FROM corpus"""

SQL["route_requests"] = """SELECT item_id AS qid, r.route, coalesce(text, '') AS text, CAST(r.n AS BIGINT) AS n,
       CASE WHEN coalesce(text, '') = '' THEN 'rejected' ELSE 'ok' END AS status,
       CASE WHEN coalesce(text, '') = '' THEN r.error END AS error
FROM benchmark, (VALUES ('chat', 5, 'Question is required'), ('search', 10, 'Query is required'),
                        ('semantic-search', 10, 'Query is required')) AS r(route, n, error)"""

SQL["page_parts"] = f"""WITH {DOCS},
pages AS (SELECT d.doc_id AS file, t.page_no, t.text
          FROM docs d, unnest(string_split(d.content, {NL})) WITH ORDINALITY AS t(text, page_no)),
kept AS (SELECT file, page_no, '--- Page ' || page_no::VARCHAR || ' ---' || {NL} || text || {NL} AS body
         FROM pages WHERE trim(text, {WS}) <> ''),
placed AS (SELECT *, CAST(coalesce(sum(length(body) + 1) OVER (PARTITION BY file ORDER BY page_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM kept)
SELECT file, start // {C.PART_CHARS} AS part, min(start) AS start, string_agg(body, {NL} ORDER BY page_no) AS text
FROM placed GROUP BY file, start // {C.PART_CHARS}"""

# each text is written as one line and its line end; carriage returns end lines too
_FILE_LINES = f"""{DOCS},
texts AS (SELECT nullif(type, '') AS type, regexp_replace(content || {NL}, chr(13) || chr(10) || '?', {NL}, 'g') AS t,
                 CASE WHEN regexp_matches(content, '[^\\x{{00}}-\\x{{ff}}]') THEN 'utf-8' ELSE 'latin-1' END AS written,
                 CASE WHEN regexp_matches(content, '[^\\x{{00}}-\\x{{ff}}]') THEN octet_length(encode(content)) ELSE length(content) END + 1 AS size
          FROM docs WHERE content IS NOT NULL)"""

SQL["folder_lines"] = f"""WITH {_FILE_LINES},
lines AS (SELECT type, unnest(string_split(t[:-2], {NL})) AS l FROM texts)
SELECT type, CASE WHEN starts_with(l, '     ') THEN substring(l, 6) ELSE l END AS utterance
FROM lines WHERE l <> '' AND NOT starts_with(l, '<')"""

SQL["folder_totals"] = f"""WITH {_FILE_LINES}
SELECT type, written, CAST(sum(length(t) - length(replace(t, {NL}, ''))) AS BIGINT) AS total_lines, CAST(sum(size) AS BIGINT) AS total_bytes
FROM texts GROUP BY type, written"""
