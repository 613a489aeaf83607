"""Document -> corpus rows: P1 fixed chunks, P2 utterance lines, F2/F3 blank
and header filters, W3 ids.  All narrow (explode) except the id assignment."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragtide.functions.text import (
    CHUNK_SIZE, HEADER_MARKER, UTTERANCE_PREFIX, chunk_array, is_blank, py_strip,
)
from ragtide.operators.ids import in_order, stored_ids


def kept_chunks(content, size: int = CHUNK_SIZE):
    """P1 + F2 as one array per document: the stripped content cut into
    ``size`` code-point slices, blank slices removed, each kept slice with
    its 0-based slice number: ``array<struct<chunk_index, corpus>>``.  The
    position in this array is the chunk's rank among the document's kept
    chunks, so ids need no window over chunk rows."""
    arr = chunk_array(py_strip(content), size)
    tagged = F.transform(arr, lambda x, i: F.struct(i.cast("long").alias("chunk_index"), x.alias("corpus")))
    return F.filter(tagged, lambda s: ~is_blank(s["corpus"]))


def chunk_documents(docs: DataFrame, *, content_col: str = "content", size: int = CHUNK_SIZE,
                    keep: tuple[str, ...] = ("doc_id", "file", "type", "created_at")) -> DataFrame:
    """P1 + F2: strip the document, drop it if blank, cut it into ``size``
    code-point slices, keep non-blank slices unstripped.  Output columns:
    ``keep`` + chunk_index (0-based slice number) + corpus.  Narrow: no
    shuffle."""
    ex = docs.select(*keep, F.explode(kept_chunks(F.col(content_col), size)).alias("_c"))
    return ex.select(*keep, "_c.chunk_index", "_c.corpus")


def first_chunk(docs: DataFrame, *, content_col: str = "content", size: int = CHUNK_SIZE,
                keep: tuple[str, ...] = ("doc_id", "file", "type", "created_at")) -> DataFrame:
    """Chunk 0 of every document (when not blank), without cutting the rest."""
    s = py_strip(content_col)
    c = F.substring(s, 1, size)
    return (docs.select(*keep, c.alias("corpus")).where((F.col("corpus") != "") & ~is_blank("corpus"))
            .withColumn("chunk_index", F.lit(0).cast("long")))


def numbered_chunks(docs: DataFrame, order_cols: list[str], *, content_col: str = "content",
                    size: int = CHUNK_SIZE, keep: tuple[str, ...] = ()) -> DataFrame:
    """W3 over P1: chunk rows with dense ids 1..N in (order_cols, chunk_index)
    order, NULL keys first.  Documents that share a key (files of one name in
    two folders) are told apart by their text's hash and their other columns, so
    each is numbered once.

    The documents are shuffled once into ranges of the key, cut there once, and
    stored (``ids.in_order``, ``ids.stored_ids``): ids are added while reading."""
    cols = list(dict.fromkeys([*order_cols, *keep]))
    others = [c for c in cols if c not in order_cols]
    d = docs.select(*cols, F.col(content_col).alias("_text"), F.xxhash64(content_col).alias("_h")) \
        .where(~is_blank("_text"))
    srt = in_order(d, list(order_cols), ["_h", *others])
    ex = srt.select(*cols, F.explode(kept_chunks(F.col("_text"), size)).alias("_c"))
    return stored_ids(ex.select(*cols, "_c.chunk_index", "_c.corpus"), "id", "chunks")


def chunk_rows(docs: DataFrame, keep: tuple[str, ...], *, content_col: str = "content",
               size: int = CHUNK_SIZE) -> DataFrame:
    """Kept chunk rows with ``_pos``, the chunk's 0-based rank among its
    document's kept chunks (narrow: no shuffle)."""
    ex = docs.select(*keep, F.posexplode(kept_chunks(F.col(content_col), size)).alias("_pos", "_c"))
    return ex.select(*keep, F.col("_pos").cast("long").alias("_pos"), "_c.chunk_index", "_c.corpus")


def ids_for_rows(docs: DataFrame, rows: DataFrame, key: str, *, content_col: str = "content",
                 size: int = CHUNK_SIZE) -> DataFrame:
    """The ``numbered_chunks`` ids of a bounded set of ``chunk_rows`` (a
    top-n report), without numbering the corpus: id = kept chunks of every
    document before this one in key order (NULL keys first) + ``_pos`` + 1.

    The rows' distinct keys are collected (bounded by the report's size).
    Numeric keys: every document is bucketed by the first collected key at
    or above its own (``Bucketizer``, a binary search), chunk counts are
    summed per bucket (a partial aggregate, one row per key) and the running
    sum over those few rows gives each key's start.  Other keys: one
    conditional sum per key.  Narrow passes and small aggregates only."""
    keys = [r[key] for r in rows.select(key).distinct().collect()]      # bounded by the report
    present = sorted(k for k in keys if k is not None)
    n = F.greatest(F.coalesce(F.size(kept_chunks(F.col(content_col), size)), F.lit(0)), F.lit(0))
    starts: dict = {}
    splits = [float("-inf")] + [float(k) for k in present] + [float("inf")] \
        if isinstance(docs.schema[key].dataType, T.NumericType) else []
    exact = bool(present and splits) and all(a < b for a, b in zip(splits, splits[1:]))  # distinct as doubles
    if exact:
        # bucket i holds documents with present[i-1] <= key < present[i];
        # bucket 0 also holds NULL keys (as -inf), which sort first
        kd = F.coalesce(F.col(key).cast("double"), F.lit(float("-inf")))
        b = Bucketizer(splits=splits, inputCol="_k", outputCol="_b", handleInvalid="keep").transform(
            docs.select(kd.alias("_k"), n.alias("_n")))
        per = {int(r["_b"]): int(r["s"]) for r in b.groupBy("_b").agg(F.sum("_n").alias("s")).collect()}
        acc = 0
        for i, k in enumerate(present):
            acc += per.get(i, 0)
            starts[k] = acc
    elif present:
        null_n = F.coalesce(F.sum(F.when(F.col(key).isNull(), n)), F.lit(0))
        sums = [(F.coalesce(F.sum(F.when(F.col(key) < F.lit(k), n)), F.lit(0)) + null_n).alias(f"o{i}")
                for i, k in enumerate(present)]
        offs = docs.agg(*sums).first()
        starts = {k: int(offs[f"o{i}"]) for i, k in enumerate(present)}
    start = F.when(F.col(key).isNull(), F.lit(0))
    if starts:
        m = F.create_map(*[x for k, v in starts.items() for x in (F.lit(k), F.lit(v))])
        start = start.otherwise(m[F.col(key)])
    return rows.withColumn("id", (start + F.col("_pos") + 1).cast("long"))


def corpus_table(docs: DataFrame, *, order_cols=("doc_id",), **kw) -> DataFrame:
    """Chunks with dense ids in insert order (W3):
    (id, corpus, file_name, file_type, created_at, doc_id, chunk_index)."""
    ided = numbered_chunks(docs, list(order_cols), keep=("doc_id", "file", "type", "created_at"), **kw)
    return ided.select("id", "corpus", F.col("file").alias("file_name"),
                       F.col("type").alias("file_type"), "created_at", "doc_id", "chunk_index")


def split_lines(docs: DataFrame, *, text_col: str = "content",
                keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Split on ``\\n``; drop empty lines and lines starting with the
    header marker (tested before the prefix is removed); remove one
    five-space prefix.  Whitespace-only lines are kept.  line_no is the
    1-based position in the file."""
    ex = docs.select(*keep, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("_i", "_l"))
    ex = ex.where((F.col("_l") != "") & ~F.col("_l").startswith(HEADER_MARKER))
    n = len(UTTERANCE_PREFIX)
    utt = F.when(F.col("_l").startswith(UTTERANCE_PREFIX), F.expr(f"substring(_l, {n + 1})")) \
        .otherwise(F.col("_l"))
    return ex.select(*keep, (F.col("_i") + 1).cast("long").alias("line_no"), utt.alias("utterance"))
