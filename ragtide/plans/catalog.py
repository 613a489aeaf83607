"""Named queries over the test tables: each takes (spark, sf_dir) and returns a
DataFrame whose columns match the oracle SQL in ``plans.oracle``.

Doubles are rounded (6 decimals for scores) so that two engines summing in a
different order hash the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragtide.functions.text import (
    LENGTH_LABELS_FR, LENGTH_LABELS_RANGE, SNIPPET_CONSOLE, base_name, decode_fallback, iso_timestamp, is_blank,
    line_count, normalize_newlines, py_strip, size_kb, snippet,
)
from ragtide.functions.like import ilike_contains
from ragtide.functions.vector import parse_vector, render_vector, vector_is_valid
from ragtide.operators.ids import dense_index
from ragtide.operators import (
    ann, chunking, context, embed, grams, history, ingest, keyword, stat_states, stats, stored_history, topk,
)
from ragtide.session import shared_path, shared_table
from ragtide.sources import lines as lines_src
from ragtide.sources import pages as pages_src
from ragtide.sources.tables import documents_as_files, stored_vectors, table

# --- fixed values (query parameters) ----------------------------------------
QUERY_VECTOR_ID = 0          # stored vector used as the single query
TOP_K = 5
KEYWORD = "the"
INDEXED_KEYWORD = "entebe"   # rarer: most folders of texts hold no candidate
CLEARED_SESSION = 0
HISTORY_BUCKETS = 8
LOADS = 3                    # loads that the merged statistics are made of
PART_CHARS = 4_000           # characters per part in the parts by character
PAGE_BLOCK = 16              # pages per block in the block-level assembly
# ----------------------------------------------------------------------------

_R = 6


def _r(c, d=_R):
    return F.round(F.col(c) if isinstance(c, str) else c, d)


def docs(spark, sf):
    return documents_as_files(spark, sf)


def corpus(spark, sf):
    """The stored corpus table: chunks with dense ids."""
    return chunking.corpus_table(docs(spark, sf))


def corpus_top(spark, sf, doc_order, pos, n: int, where=None):
    """The first ``n`` rows of the corpus table in ``order`` (optionally
    filtered), ids included, without numbering the whole corpus: a
    TakeOrderedAndProject over documents (over chunk rows with a filter), then
    ``ids_for_rows``.  The order is that of documents (over created_at, doc_id),
    then ``pos`` over _pos; (doc_id, _pos) is id order.
    The report operators then run unchanged on these n rows."""
    d = docs(spark, sf)
    first = d
    if where is None:          # a kept document has a chunk: the first n documents hold the first n chunks
        first = d.where(~is_blank("content")).orderBy(*doc_order).limit(int(n))
    ch = chunking.chunk_rows(first, ("doc_id", "file", "type", "created_at"))
    if where is not None:
        ch = ch.where(where)
    # the n rows are read twice (their keys, then the result): keep them
    # (n rows; a lost block is recomputed)
    picked = ch.orderBy(*doc_order, pos).limit(int(n)).persist(StorageLevel.MEMORY_AND_DISK)
    top = chunking.ids_for_rows(d, picked, "doc_id")
    return top.select("id", "corpus", F.col("file").alias("file_name"), F.col("type").alias("file_type"),
                      "created_at", "doc_id", "chunk_index")


def chunks(spark, sf):
    """Corpus rows without ids, for statistics that never read the id."""
    c = chunking.chunk_documents(docs(spark, sf))
    return c.select("corpus", F.col("file").alias("file_name"), F.col("type").alias("file_type"),
                    "created_at", "doc_id", "chunk_index")


# --- vector search ------------------------------------------------------------

def q_topk_cosine(spark: SparkSession, sf: str) -> DataFrame:
    v = stored_vectors(spark, sf)
    qv = topk.vector_of(v, QUERY_VECTOR_ID)
    r = topk.topk_single(v, qv, TOP_K)
    return r.select("rank", F.col("id").alias("vec_id"), _r("similarity").alias("similarity"),
                    _r("distance").alias("distance"), "relevance")


def q_topk_batch(spark, sf):
    v = stored_vectors(spark, sf)
    r = topk.topk_batch(v, v.select(F.col("id").alias("qid"), "embedding"), TOP_K)
    return r.select("qid", "rank", F.col("id").alias("vec_id"), _r("similarity").alias("similarity"))


def q_topk_l2(spark, sf):
    v = stored_vectors(spark, sf)
    r = topk.topk_batch(v, v.select(F.col("id").alias("qid"), "embedding"), TOP_K, metric="l2")
    return r.select("qid", "rank", F.col("id").alias("vec_id"), _r("distance").alias("distance"))


def q_cosine_scores(spark, sf):
    v = stored_vectors(spark, sf)
    s = topk.score_corpus(v, topk.vector_of(v, QUERY_VECTOR_ID))
    return s.select(F.col("id").alias("vec_id"), _r("similarity").alias("similarity"),
                    _r("distance").alias("distance"),
                    F.round(F.col("similarity") * 100.0, 1).alias("relevance"),
                    _r("l2_distance").alias("l2_distance"))


def q_parse_vector_roundtrip(spark, sf):
    v = stored_vectors(spark, sf)
    b = parse_vector(render_vector("embedding", "[]"))
    c = parse_vector(render_vector("embedding", "{}"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    return v.select(F.col("id").alias("vec_id"), F.size(b).cast("long").alias("dim"),
                    _r(total(b)).alias("sum_bracket"), _r(total(c)).alias("sum_brace"),
                    vector_is_valid(b).alias("valid"))


# --- chunking -------------------------------------------------------------------

def q_chunk_documents(spark, sf):
    c = corpus(spark, sf)
    return c.select("id", "doc_id", "chunk_index", "corpus", "file_name", "file_type",
                    F.length("corpus").cast("long").alias("length"))


def q_split_utterances(spark, sf):
    return chunking.split_lines(docs(spark, sf), text_col="content")


def q_utterance_ingest(spark, sf):
    """The utterance table (lines, dense ids, vectors; no file columns), written and read back.
    A document's file name is its doc_id, zero-padded so that names sort as ids do."""
    d = docs(spark, sf).select(F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("file"), "content")
    path = shared_path(spark, "utterances")
    ingest.write_corpus(ingest.build_utterances(d), path)
    t = ingest.read_corpus(spark, path, ingest.UTTERANCE_SCHEMA)
    return t.select("id", "corpus", F.size("embedding").cast("long").alias("dim"))


def q_corpus_append(spark, sf):
    """K1 and K2: the documents of the even ids as a new table, the others appended, read back."""
    d, path = docs(spark, sf), shared_path(spark, "corpus")
    d = d.select(F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("file"), "content", F.lit("txt").alias("type"),
                 (F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == 0).alias("even"))
    ingest.write_corpus(ingest.build_corpus(d.where("even")), path)
    ingest.append_corpus(d.where("not even"), path, load="odd")
    t = ingest.read_corpus(spark, path)
    return t.select("id", "corpus", "file_name", "file_type", F.size("embedding").cast("long").alias("dim"))


# --- statistics -----------------------------------------------------------------

def q_corpus_stats(spark, sf):
    return stats.corpus_stats(chunks(spark, sf))


def q_stats_display(spark, sf):
    return stats.stats_display(chunks(spark, sf))


def q_length_histogram_fr(spark, sf):
    return stats.length_histogram(chunks(spark, sf), LENGTH_LABELS_FR)


def q_length_histogram_range(spark, sf):
    return stats.length_histogram(chunks(spark, sf), LENGTH_LABELS_RANGE)


def q_type_counts(spark, sf):
    return stats.type_counts(chunks(spark, sf))


def q_file_distribution(spark, sf):
    return stats.file_distribution(chunks(spark, sf))


def q_ingest_summary(spark, sf):
    return stats.ingest_summary(docs(spark, sf))


def q_date_range(spark, sf):
    return stats.date_range(chunks(spark, sf))


def merged_states(spark, sf):
    """The corpus in ``LOADS`` loads (by doc_id), each adding its statistics' states, read back."""
    path, c = shared_path(spark, "states"), chunks(spark, sf)
    for k in range(LOADS):
        part = F.coalesce(F.pmod("doc_id", F.lit(LOADS)), F.lit(0)) == k
        stat_states.write_states(c.where(part), path, f"load-{k}")
    return stat_states.read_states(spark, path)


def q_merged_corpus_stats(spark, sf):
    return stat_states.corpus_stats(merged_states(spark, sf))


def q_merged_length_histogram(spark, sf):
    return stat_states.length_histogram(merged_states(spark, sf))


def q_merged_type_counts(spark, sf):
    return stat_states.type_counts(merged_states(spark, sf))


def q_merged_file_distribution(spark, sf):
    return stat_states.file_distribution(merged_states(spark, sf))


def q_recent_rows(spark, sf):
    # (created_at desc, id desc): id order is (doc_id, _pos)
    top = corpus_top(spark, sf, [F.col("created_at").desc(), F.col("doc_id").desc()], F.col("_pos").desc(), 5)
    return stats.recent_rows(top)


def q_table_preview(spark, sf):
    return stats.table_preview(corpus_top(spark, sf, ["doc_id"], "_pos", 10))


# --- keyword search -------------------------------------------------------------

def q_keyword_search(spark, sf):
    hits = corpus_top(spark, sf, ["doc_id"], "_pos", 10, where=ilike_contains("corpus", KEYWORD))
    return keyword.keyword_search(hits, KEYWORD)


def q_keyword_indexed(spark, sf):
    """F1 over a stored corpus with postings: stored, indexed, then searched without a scan of the texts."""
    path = shared_path(spark, "postings")
    grams.write_postings(corpus(spark, sf).select("id", "corpus", "created_at", "file_name"), path)
    return keyword.keyword_search(grams.indexed_search(spark, path, INDEXED_KEYWORD), INDEXED_KEYWORD)


def q_keyword_count(spark, sf):
    return keyword.keyword_count(chunks(spark, sf), KEYWORD)


def benchmark_keywords(spark, sf):
    """Keywords derived from the data: every word of each benchmark item,
    lower-cased; ``qid`` is item_id * 1,000,000 + the word's place (from 1)."""
    b = table(spark, sf, "benchmark")
    words = F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    w = b.select("item_id", F.posexplode(words).alias("_p", "keyword"))
    return w.select((F.col("item_id").cast("long") * 1_000_000 + F.col("_p") + 1).alias("qid"), "keyword")


def q_keyword_batch(spark, sf):
    r = keyword.keyword_batch(corpus(spark, sf).select("id", "corpus"), benchmark_keywords(spark, sf))
    return r.select("qid", "rank", "id", "matches")


# --- pages ------------------------------------------------------------------------

def _pages(spark, sf):
    return pages_src.pages_from_lines(docs(spark, sf))


def q_page_assembly(spark, sf):
    return pages_src.assemble_pages(_pages(spark, sf), marked=False)


def q_page_assembly_marked(spark, sf):
    return pages_src.assemble_pages(_pages(spark, sf), marked=True)


def q_page_blocks(spark, sf):
    """S5 at block level: files of any size stay whole as ordered blocks."""
    return pages_src.assemble_page_blocks(_pages(spark, sf), marked=True, block_pages=PAGE_BLOCK)


def q_page_parts(spark, sf):
    """The text of each file in parts by character, written as the extracted-text table and read back."""
    path = shared_path(spark, "extracted")
    pages_src.write_extracted_text(pages_src.page_parts(_pages(spark, sf), marked=True, part_chars=PART_CHARS), path)
    return spark.read.schema("file long, part long, start long, text string").parquet(path)


def q_page_summary(spark, sf):
    return pages_src.page_summary(_pages(spark, sf), marked=True)


def q_union_documents(spark, sf):
    d = docs(spark, sf).select(F.col("doc_id").alias("source_id"), "file", "content", "type")
    p = table(spark, sf, "pages").select(F.col("page_id").alias("source_id"), F.col("url").alias("file"),
                                         F.col("html").alias("content"), F.lit("html").alias("type"))
    u = d.unionByName(p)
    return u.select("source_id", "file", "type", py_strip("content").alias("content")) \
        .where(F.col("content") != "")


def q_decode_documents(spark, sf):
    """Every document as file bytes (latin-1 where the text fits into it,
    else utf-8; lines end in CR LF), decoded as text-mode reading does."""
    d = docs(spark, sf).select("doc_id", F.regexp_replace("content", "\n", "\r\n").alias("t"))
    raw = F.when(F.col("t").rlike(r"^[\x00-\xFF]*$"), F.encode("t", "ISO-8859-1")).otherwise(F.encode("t", "UTF-8"))
    text = normalize_newlines(decode_fallback(raw))
    return d.select("doc_id", text.alias("text"))


def q_page_files(spark, sf):
    """P7, P8 and A9's figures of every page taken as a file: name, size in KB, lines."""
    return table(spark, sf, "pages").select(
        "page_id", base_name("url").alias("name"), size_kb(F.octet_length("html")).alias("size_kb"),
        line_count(normalize_newlines("html")).alias("lines"))


def _text_folder(spark, sf):
    """Stand-in folder of text files: Spark writes the documents' texts under a folder per type, those of latin-1
    characters in that encoding."""
    path = shared_path(spark, "texts")
    d = docs(spark, sf).where(F.col("content").isNotNull())
    narrow = ~F.col("content").rlike("[^\\x{0}-\\x{ff}]")
    value = F.when(narrow, F.encode(F.when(narrow, F.col("content")), "ISO-8859-1").cast("string")).otherwise(F.col("content"))
    (d.select("type", F.when(narrow, F.lit("latin-1")).otherwise(F.lit("utf-8")).alias("written"), value.alias("value"))
     .write.partitionBy("type", "written").text(path))
    return lines_src.read_lines(spark, path, partitions="type string, written string")


def q_folder_lines(spark, sf):
    """S1, S2, S3, P2 over text files read in byte ranges: every utterance of every file."""
    lines, _ = _text_folder(spark, sf)
    return chunking.split_lines(lines_src.line_documents(lines), keep=("type",)).select("type", "utterance")


def q_folder_totals(spark, sf):
    """A9 over the same files: lines of each folder (its files' number and sizes follow the write tasks)."""
    _, files = _text_folder(spark, sf)
    return files.groupBy("type", "written").agg(F.sum("lines").alias("total_lines"), F.sum("size_bytes").alias("total_bytes"))


# --- chat requests ------------------------------------------------------------------

def ranked_vectors(spark, sf):
    """Stored vectors by their place in vec_id order (from 0): (_place, embedding)."""
    v = dense_index(stored_vectors(spark, sf).where(F.col("id").isNotNull()), ["id"], "_n")
    return v.select((F.col("_n") - 1).alias("_place"), "embedding")


def rag_corpus(spark, sf):
    """Every chunk of the corpus with a vector: chunk number id - 1 modulo the number of vectors
    names the place of its vector in vec_id order, whatever ids documents and vectors
    have (a synthetic pairing; the tables are unrelated)."""
    v = shared_table(ranked_vectors(spark, sf), "vectors")
    c = corpus(spark, sf).select("id", "corpus", "created_at", F.pmod(F.col("id") - 1, F.lit(max(v.count(), 1))).alias("_place"))
    return c.join(v, "_place").drop("_place")


def rag_requests(spark, sf, default_top_k=context.DEFAULT_TOP_K_CHAT):
    """Chat requests: one per benchmark item (question = its text, no top_k so
    the default applies)."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return context.normalize_requests(b, default_top_k=default_top_k)


def rag_hits(spark, sf, default_top_k=context.DEFAULT_TOP_K_CHAT):
    """The answers' chunks.  The corpus is stored first, as the reference's is: its ids and vectors are
    read by the search, its texts for the winners alone.  A request takes the vector at place item_id modulo
    the number of vectors (synthetic pairing)."""
    req = rag_requests(spark, sf, default_top_k).where(F.col("status") == "ok")
    stored = shared_table(rag_corpus(spark, sf), "corpus")
    v = shared_table(ranked_vectors(spark, sf), "vectors")
    qv = req.withColumn("_place", F.pmod("qid", F.lit(max(v.count(), 1)))).join(v, "_place").drop("_place")
    return topk.topk_batch(stored, qv, k_col="top_k", carry=["corpus"], unique_ids=True)


def q_request_normalize(spark, sf):
    return rag_requests(spark, sf)


def q_route_requests(spark, sf):
    """P13 of all routes: each benchmark item asked on each, under the key "query" (the number absent)."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return context.route_requests(b.withColumn("route", F.explode(F.array(*[F.lit(r) for r in context.ROUTES]))))


def q_sources(spark, sf):
    return context.sources(rag_hits(spark, sf), None)


def q_context_prompt(spark, sf):
    req = rag_requests(spark, sf).where(F.col("status") == "ok")
    return context.context_prompt(rag_hits(spark, sf), None, req)


def q_context_prompt_short(spark, sf):
    """The notebook flow: top-3 per question, the short prompt, and source
    snippets of 80 characters."""
    req = rag_requests(spark, sf, default_top_k=3).where(F.col("status") == "ok")
    hits = rag_hits(spark, sf, default_top_k=3)
    ctx = context.context_prompt(hits, None, req, style="short")
    snips = (hits.groupBy("qid")
             .agg(F.array_sort(F.collect_list(F.struct("rank", snippet("corpus", SNIPPET_CONSOLE)
                                                       .alias("s")))).alias("_s"))
             .select("qid", F.array_join(F.transform("_s", lambda x: x["s"]), "\n").alias("source_snippets")))
    return ctx.join(snips, "qid", "left").select("qid", "question", "sources_count", "prompt",
                                                 F.coalesce("source_snippets", F.lit("")).alias("source_snippets"))


def q_semantic_search(spark, sf):
    hits = rag_hits(spark, sf, default_top_k=context.DEFAULT_TOP_K_SEMANTIC)
    return hits.select(
        "qid", "rank", "id", F.col("corpus").alias("text"),
        F.round(F.col("similarity") * 100.0, 1).alias("relevance"))


# --- history --------------------------------------------------------------------------

def _history(spark, sf):
    return history.interactions_from_turns(table(spark, sf, "conversations"))


def q_history_last_n(spark, sf):
    return history.history_last_n(_history(spark, sf), history.HISTORY_LAST_N)


def q_history_last_2(spark, sf):
    return history.history_last_n(_history(spark, sf), 2)


def q_history_clear(spark, sf):
    h = history.clear_history(_history(spark, sf), CLEARED_SESSION)
    return h.select("session_id", "seq", "query", "answer", iso_timestamp("ts").alias("timestamp"))


def q_history_stored(spark, sf):
    """W2, W5 over the stored form: half of the interactions written, the others appended, a session cleared."""
    h, path = _history(spark, sf), shared_path(spark, "history")
    late = F.pmod(F.col("seq"), F.lit(4)) > 1
    stored_history.write_history(h.where(~late), path, HISTORY_BUCKETS)
    stored_history.append_history(h.where(late), path, HISTORY_BUCKETS)
    stored_history.clear_session(spark, path, CLEARED_SESSION, HISTORY_BUCKETS)
    return stored_history.last_n(spark, path)


# --- rows-only (no SQL oracle) ----------------------------------------------------------

def q_text_search_hashed(spark, sf):
    """End-to-end text search: chunks and benchmark questions embedded by the
    stand-in encoder, top-5 per question.  Each chunk is encoded once: the vectors are stored before the search."""
    c = shared_table(embed.embed(corpus(spark, sf).select("id", "corpus"), "corpus", "embedding").select("id", "embedding"), "vectors")
    qs = embed.embed(table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text"),
                     "text", "embedding")
    r = topk.topk_batch(c, qs, TOP_K)
    return r.select("qid", "rank", "id", _r("similarity").alias("similarity"))


def q_ann_topk(spark, sf):
    v = stored_vectors(spark, sf)
    r = ann.ann_topk(v, v.select(F.col("id").alias("qid"), "embedding"), TOP_K)
    return r.select("qid", "rank", F.col("id").alias("vec_id"), _r("similarity").alias("similarity"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "topk_cosine": q_topk_cosine,
    "topk_batch": q_topk_batch,
    "topk_l2": q_topk_l2,
    "cosine_scores": q_cosine_scores,
    "parse_vector_roundtrip": q_parse_vector_roundtrip,
    "chunk_documents": q_chunk_documents,
    "split_utterances": q_split_utterances,
    "corpus_stats": q_corpus_stats,
    "stats_display": q_stats_display,
    "length_histogram_fr": q_length_histogram_fr,
    "length_histogram_range": q_length_histogram_range,
    "type_counts": q_type_counts,
    "file_distribution": q_file_distribution,
    "ingest_summary": q_ingest_summary,
    "date_range": q_date_range,
    "utterance_ingest": q_utterance_ingest,
    "corpus_append": q_corpus_append,
    "merged_corpus_stats": q_merged_corpus_stats,
    "merged_length_histogram": q_merged_length_histogram,
    "merged_type_counts": q_merged_type_counts,
    "merged_file_distribution": q_merged_file_distribution,
    "route_requests": q_route_requests,
    "history_stored": q_history_stored,
    "recent_rows": q_recent_rows,
    "table_preview": q_table_preview,
    "keyword_search": q_keyword_search,
    "keyword_indexed": q_keyword_indexed,
    "keyword_count": q_keyword_count,
    "keyword_batch": q_keyword_batch,
    "page_assembly": q_page_assembly,
    "page_assembly_marked": q_page_assembly_marked,
    "page_blocks": q_page_blocks,
    "page_parts": q_page_parts,
    "folder_lines": q_folder_lines,
    "folder_totals": q_folder_totals,
    "page_summary": q_page_summary,
    "union_documents": q_union_documents,
    "decode_documents": q_decode_documents,
    "page_files": q_page_files,
    "request_normalize": q_request_normalize,
    "sources": q_sources,
    "context_prompt": q_context_prompt,
    "context_prompt_short": q_context_prompt_short,
    "semantic_search": q_semantic_search,
    "history_last_n": q_history_last_n,
    "history_last_2": q_history_last_2,
    "history_clear": q_history_clear,
    "text_search_hashed": q_text_search_hashed,
    "ann_topk": q_ann_topk,
}
