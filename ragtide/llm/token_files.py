"""Token ids of whole documents as Huffman-coded files.

``write_tokens`` encodes documents with a tokenizer, appends an end id to each, and
writes a folder:

* ``codebook``: (symbol, bits) of every id that occurs, a canonical Huffman code
  of at most ``LIMIT`` bits made from the ids' counts over all documents;
* ``blocks``: the ids in ascending (doc_id, content) order.  ``part`` is a range of
  documents, ``block`` an independent block of whole documents with ``BLOCK`` ids
  or more (one document may be longer), ``start`` the ids before it in its part.  ``stream``
  holds its ids' codes, ``checks`` (32-bit, little-endian) the bit offset of every ``CHECK``-th id,
  ``crc`` the ids' CRC-32.

The folder is Parquet: Spark's writer commits it, and any store that Spark
reads will do.  ``read_tokens`` needs nothing but the folder.  ``read_range`` reads ids by their
place in the whole stream and decodes only from the checkpoint before it.

Only the counts of the vocabulary's ids (a number fixed by the tokenizer) and one
number per part reach the driver.  Documents are dealt by ranges of (doc_id, hash
of the ids, place in the written table), so that neither a repeated id nor repeated rows fill one range.

Defined cases: a null text is an empty one, whose one id is the end id; a null
doc_id stands before all others; rows with one doc_id follow one another, each
a document; an empty table gives an empty codebook and no blocks; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .huffman import CHECK, Decoder, Encoder, LIMIT, code_lengths
from .packing import _tokenizer
from .shared import shared_dir
from .text import string_buffers

END_ID, BLOCK = 2, 1 << 16
BLOCK_SCHEMA = ("part int, block int, start long, n_ids long, doc_ids array<long>, lengths array<long>, "
                "stream binary, checks binary, crc long")
TOKEN_SCHEMA = "doc_id long, ids binary, counts binary"
_ROWS = 64


def tokenised(df: DataFrame, path: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, ids), ``ids`` as little-endian 16-bit numbers where the vocabulary allows, else 32-bit; and
    a row (counts) of every task, how often each id occurred (64-bit, compressed), where ``ids`` is null."""
    end = struct.pack("<I", end_id)
    typ, size = id_type(path, end_id), vocabulary_size(path, end_id)

    def part(batches):
        tok, sums = _tokenizer(path), np.zeros(size, np.int64)
        for batch in batches:
            buf, offs = string_buffers(batch.column("__text"))
            for i in range(0, batch.num_rows, _ROWS):
                js = range(i, min(i + _ROWS, batch.num_rows))
                got = [b + end for b in tok.encode([buf[offs[j]: offs[j + 1]].tobytes() for j in js])]
                ids = np.frombuffer(b"".join(got), "<u4")
                sums += np.bincount(ids, minlength=size)
                yield pa.RecordBatch.from_arrays([batch.column("__id").slice(i, len(js)), _binary(ids.astype(typ), np.cumsum([0, *map(len, got)]) // 4),
                                                  pa.nulls(len(js), pa.binary())], names=["doc_id", "ids", "counts"])
        if sums.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([zlib.compress(sums.tobytes(), 1)], pa.binary())],
                                             names=["doc_id", "ids", "counts"])

    src = df.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("string").alias("__text"))
    return src.mapInArrow(part, TOKEN_SCHEMA)


def _binary(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The ids between neighbouring ``ends`` as one binary value each, without copying them."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * ids.itemsize).astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())


def vocabulary_size(path: str, end_id: int) -> int:
    return max(_tokenizer(path).tok.get_vocab_size(), end_id + 1)


def id_type(path: str, end_id: int) -> str:
    return "<u2" if vocabulary_size(path, end_id) <= 1 << 16 else "<u4"


def id_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id below ``size`` occurs: the tasks' rows are summed by id on the executors; ``size`` numbers reach the driver."""
    def part(batches):
        sums = np.zeros(size, np.int64)
        for batch in batches:
            for c in batch.column("counts").to_pylist():
                sums += np.frombuffer(zlib.decompress(c), np.int64)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(sums[at])], names=["id", "n"])

    out = np.zeros(size, np.int64)
    rows = tokens.filter("counts is not null").select("counts").mapInArrow(part, "id long, n long")
    for r in rows.groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["id"]] = r["n"]
    return out


def _blocks(lengths, typ: str, block: int):
    """mapInArrow body over one range of documents in order: its blocks."""
    def run(batches):
        enc, part = Encoder(lengths.value), TaskContext.get().partitionId()
        state = {"block": 0, "start": 0}

        def close(docs, many):
            ids = np.concatenate([np.frombuffer(b, typ) for b in many])
            stream, checks = enc.encode(ids)
            row = [part, state["block"], state["start"], len(ids), docs, [len(b) // np.dtype(typ).itemsize for b in many], stream,
                   checks.astype("<u4").tobytes(), zlib.crc32(ids.astype("<u4").tobytes())]
            state["block"] += 1
            state["start"] += len(ids)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _ARROW)], names=_NAMES)

        docs, many, size = [], [], 0
        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                docs.append(doc)
                many.append(ids)
                size += len(ids) // np.dtype(typ).itemsize
                if size >= block:
                    yield close(docs, many)
                    docs, many, size = [], [], 0
        if docs:
            yield close(docs, many)
    return run


_NAMES = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
_ARROW = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]


def write_tokens(df: DataFrame, path: str, folder: str | None = None, end_id: int = END_ID, block: int = BLOCK, limit: int = LIMIT,
                 doc_id: str = "doc_id", text: str = "text") -> str:
    """Write the folder (by default a new one in the shared folder) and return its path; ``path`` is the tokenizer's file."""
    spark = df.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex[:12]}"
    staged = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex[:12]}-ids"
    tokenised(df, path, end_id, doc_id, text).write.parquet(staged)
    tokens = spark.read.schema(TOKEN_SCHEMA).parquet(staged)
    typ = id_type(path, end_id)
    lengths = code_lengths(id_counts(tokens, vocabulary_size(path, end_id)), limit)
    used = np.flatnonzero(lengths)
    book = spark.createDataFrame(pa.table({"symbol": pa.array(used, pa.int64()), "bits": pa.array(lengths[used], pa.int64())}))
    book.coalesce(1).write.parquet(f"{folder}/codebook")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("doc_id").asc_nulls_first(), "__h", "__n"]
    dealt = tokens.filter("ids is not null").select("doc_id", "ids", F.xxhash64("ids").alias("__h"), F.monotonically_increasing_id().alias("__n"))
    dealt = dealt.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "ids")
    sent = spark.sparkContext.broadcast(lengths)          # one number per id of the vocabulary
    dealt.mapInArrow(_blocks(sent, typ, block), BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    sent.destroy()
    return folder


class _Folder:
    """What a reader needs: the code's lengths and the ids before each part."""

    def __init__(self, spark: SparkSession, folder: str):
        book = spark.read.schema("symbol long, bits long").parquet(f"{folder}/codebook").toArrow()      # at most the vocabulary
        symbols = book.column("symbol").to_numpy()
        self.lengths = np.zeros(int(symbols.max()) + 1 if len(symbols) else 1, np.int64)
        self.lengths[symbols] = book.column("bits").to_numpy()
        self.blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks")
        sizes = {r["part"]: r["n"] for r in self.blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}    # a row per part
        self.base, at = {}, 0
        for part in sorted(sizes):
            self.base[part] = at
            at += sizes[part]
        self.n_ids = at


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the folder: ``start`` counts the ids
    of all documents before it, ``ids`` are little-endian unsigned 32-bit numbers.  A
    block whose ids do not have the CRC written beside them raises."""
    f = _Folder(spark, folder)
    sent = spark.sparkContext.broadcast((f.lengths, f.base))

    def part(batches):
        lengths, base = sent.value
        dec = Decoder(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i] for c in _NAMES}
                n = r["n_ids"].as_py()
                ids = dec.decode(r["stream"].as_py(), np.frombuffer(r["checks"].as_py(), "<u4"), n)
                raw = ids.astype("<u4").tobytes()
                if zlib.crc32(raw) != r["crc"].as_py():
                    raise ValueError(f"block {r['block'].as_py()} of part {r['part'].as_py()} is damaged")
                ends = np.concatenate([[0], np.cumsum(r["lengths"].values.to_numpy())])
                yield pa.RecordBatch.from_arrays(
                    [r["doc_ids"].values, pa.array(ends[:-1] + (base[r["part"].as_py()] + r["start"].as_py())),
                     _binary(np.frombuffer(raw, "<u4"), ends)], names=["doc_id", "start", "ids"])

    return f.blocks.mapInArrow(part, "doc_id long, start long, ids binary")


def read_range(spark: SparkSession, folder: str, start: int, n: int) -> np.ndarray:
    """The ids ``start`` .. ``start + n - 1`` of the whole stream, as one array.  Only the blocks
    that hold them are read, and each is decoded from the checkpoint before the first of them."""
    f = _Folder(spark, folder)
    lengths, stop, out = f.lengths, start + n, []
    near = [p for p in f.base if f.base[p] < stop]
    near = [p for p in near if not any(f.base[p] < f.base[q] <= start for q in near)]
    if not near:
        return np.empty(0, np.uint32)
    begin = F.create_map(*(x for p in near for x in (F.lit(p), F.lit(f.base[p]))))[F.col("part")] + F.col("start")
    hit = f.blocks.filter(F.col("part").isin(near)).withColumn("at", begin).filter((F.col("at") < stop) & (F.col("at") + F.col("n_ids") > start))
    dec = Decoder(lengths)
    for r in hit.orderBy("at").toLocalIterator():       # a block at a time, in order: the caller asked for one array
        skip = max(0, start - r["at"]) // CHECK
        ids = dec.decode(bytes(r["stream"]), np.frombuffer(bytes(r["checks"]), "<u4"), r["n_ids"], skip)
        lo = max(0, start - r["at"]) - skip * CHECK
        out.append(ids[lo: max(0, stop - r["at"]) - skip * CHECK])
    return np.concatenate(out) if out else np.empty(0, np.uint32)
