"""Corpus table build and write: K1 (typed table), K2 (append with ids
continuing the table), W3 ids in insert order, P11 embedding, and the
utterance table (P2 lines without file columns).

Insert order of the reference: text files first, then PDFs, each file's
chunks in order.  File order is fixed here by name (glob order is arbitrary).

A table is a folder partitioned by ``load``, written by Spark's own writer in
dynamic partition overwrite: a load that runs again replaces its own rows,
with the same ids, and no other load's files are touched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragtide.operators.chunking import numbered_chunks, split_lines
from ragtide.operators.embed import Encoder, embed
from ragtide.operators.ids import in_order, stored_ids
from ragtide.session import scratch_tables

CORPUS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("corpus", T.StringType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType()), True),
    T.StructField("file_name", T.StringType(), True),
    T.StructField("file_type", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

UTTERANCE_SCHEMA = T.StructType([CORPUS_SCHEMA[c] for c in ("id", "corpus", "embedding", "created_at")])

# --- fixed values -----------------------------------------------------------
FILE_TYPE_ORDER = ["txt", "pdf"]
# ----------------------------------------------------------------------------


def build_corpus(docs: DataFrame, *, encoder: Encoder | None = None, id_offset: int = 0) -> DataFrame:
    """Documents (file, content, type) -> corpus rows with CORPUS_SCHEMA.

    created_at is one timestamp for the whole load (the reference inserts in
    a single transaction), stored without zone in UTC."""
    spark = docs.sparkSession
    type_rank = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in FILE_TYPE_ORDER]), F.col("type")),
                           F.lit(len(FILE_TYPE_ORDER) + 1)).cast("long")
    tz = spark.conf.get("spark.sql.session.timeZone")
    now_utc = F.convert_timezone(F.lit(tz), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz"))
    d = docs.select("file", "content", "type", type_rank.alias("_tr"), now_utc.alias("created_at"))
    ided = numbered_chunks(d, ["_tr", "file"], keep=("type", "created_at"))
    rows = ided.select((F.col("id") + F.lit(int(id_offset))).alias("id"), "corpus",
                       F.col("file").alias("file_name"), F.col("type").alias("file_type"), "created_at")
    out = embed(rows, "corpus", "embedding", encoder)
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CORPUS_SCHEMA.fields])


def build_utterances(docs: DataFrame, *, encoder: Encoder | None = None, id_offset: int = 0) -> DataFrame:
    """Documents (file, content) -> one row per utterance line (P2) with an embedding and dense
    ids by file name and line: (id, corpus, embedding, created_at).  Lines of white space are
    kept, as the lines are not stripped; a document without text has none."""
    tz = docs.sparkSession.conf.get("spark.sql.session.timeZone")
    d = docs.where(F.col("content") != "").select("file", "content", F.xxhash64("content").alias("_h"))
    lines = split_lines(in_order(d, ["file"], ["_h"]), keep=())
    now_utc = F.convert_timezone(F.lit(tz), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz"))
    rows = stored_ids(lines.select(F.col("utterance").alias("corpus"), now_utc.alias("created_at")), "id", "utterances")
    out = embed(rows.withColumn("id", F.col("id") + F.lit(int(id_offset))), "corpus", "embedding", encoder)
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in UTTERANCE_SCHEMA.fields])


def write_corpus(df: DataFrame, path: str, load: str = "0") -> None:
    """K1: the table at ``path`` replaced by ``df``.  A row with a NULL id or text fails the
    write; Spark's writer removes the old table first, as the reference does."""
    _checked(df, load).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("load").parquet(path)


def write_load(df: DataFrame, path: str, load: str) -> None:
    """One load's rows, in place of those it wrote before; other loads stay as they are."""
    _checked(df, load).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(path)


def _checked(df: DataFrame, load: str) -> DataFrame:
    for c in ("id", "corpus"):
        df = df.withColumn(c, F.coalesce(c, F.raise_error(F.lit(f"a corpus row has a NULL {c}"))))
    return df.withColumn("load", F.lit(load))


def max_id(spark, path: str, but_load: str | None = None) -> int:
    """Largest id stored (0 for a missing table), read from the id column alone;
    the rows of ``but_load`` are left out (its partition is pruned)."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return 0
    t = spark.read.schema("id bigint, load string").parquet(path)
    if but_load is not None:
        t = t.where(F.col("load") != but_load)
    return int(t.agg(F.max("id")).first()[0] or 0)


def append_corpus(docs: DataFrame, path: str, *, encoder: Encoder | None = None, load: str | None = None) -> int:
    """K2: chunk, embed and append documents; ids continue after those of other loads.
    Returns the number of rows in the table afterwards.  A named load that runs again
    replaces its own rows (the last load, or later ids would follow a gap or meet its own);
    without a name each call is a load of its own."""
    spark = docs.sparkSession
    load = load or uuid.uuid4().hex
    with scratch_tables(spark):
        write_load(build_corpus(docs, encoder=encoder, id_offset=max_id(spark, path, load)), path, load)
    return read_corpus(spark, path).count()


def read_corpus(spark, path: str, schema: T.StructType = CORPUS_SCHEMA) -> DataFrame:
    """The table's rows of all loads."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("load", T.StringType())])).parquet(path) \
        .select(*schema.fieldNames())
