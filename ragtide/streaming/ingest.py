"""The folder ingest as a Structured Streaming job.

New text files dropped into a folder are decoded, stripped, chunked,
embedded and appended to the corpus table micro-batch by micro-batch; ids
continue after the largest stored id.  Progress (which files are done) lives
in the checkpoint folder, so a restarted job resumes without re-ingesting.

Each micro-batch is a load of the table (named by stream and epoch), written
by ``foreachBatch`` with dynamic partition overwrite, and its ids start after
the largest id of the other loads.  A batch that is run again (a failure after
its files were written but before the epoch was committed) therefore replaces
its own rows with the same rows and ids
instead of appending a second copy.  By default the checkpoint goes under
the session's ``spark.checkpoint.dir``; its name is a content hash of the
folder and table paths, so a restarted job finds it again.
"""

from __future__ import annotations

import hashlib

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragtide.functions.text import base_name, decode_fallback, normalize_newlines, py_strip
from ragtide.operators.embed import Encoder
from ragtide.operators.ingest import build_corpus, max_id, write_load
from ragtide.session import checkpoint_dir, scratch_tables


BINARY_FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("modificationTime", T.TimestampType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("content", T.BinaryType(), True),
])


def epoch_writer(table_path: str, stream_key: str, encoder: Encoder | None = None):
    """The ``foreachBatch`` function: epoch ``e`` of stream ``stream_key`` is the
    load ``stream-<key>-epoch-<e>`` of the table."""
    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        spark, load = batch.sparkSession, f"stream-{stream_key}-epoch-{epoch_id:012d}"
        # ordering the documents reads the batch twice: keep it instead of
        # re-reading its files (bounded by maxFilesPerTrigger; lost blocks
        # are recomputed from the files)
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            with scratch_tables(spark):
                rows = build_corpus(batch, encoder=encoder, id_offset=max_id(spark, table_path, load))
                write_load(rows, table_path, load)
        finally:
            batch.unpersist()
    return write_batch


def start_folder_ingest(spark: SparkSession, folder: str, table_path: str, *,
                        file_type: str = "txt", encoder: Encoder | None = None,
                        checkpoint: str | None = None, max_files_per_trigger: int = 1000,
                        available_now: bool = True):
    """Start the stream; returns the StreamingQuery.  ``available_now`` ingests
    what is there and stops (a scheduled batch run); otherwise it keeps
    watching the folder."""
    key = hashlib.sha1(f"{folder}\n{table_path}".encode()).hexdigest()[:16]
    shared = checkpoint_dir(spark)
    if not (checkpoint or shared):
        raise ValueError("a stream needs spark.checkpoint.dir or checkpoint=: its progress must outlive the session")
    ck = checkpoint or f"{shared.rstrip('/')}/ingest-{key}"
    stream_key = hashlib.sha1(ck.encode()).hexdigest()[:12]
    src = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
           .option("pathGlobFilter", f"*.{file_type}")
           .option("maxFilesPerTrigger", max_files_per_trigger).load(folder))
    docs = src.select(base_name("path").alias("file"),
                      py_strip(normalize_newlines(decode_fallback("content"))).alias("content"),
                      F.lit(file_type).alias("type")).where(F.col("content") != "")

    writer = docs.writeStream.foreachBatch(epoch_writer(table_path, stream_key, encoder)).option("checkpointLocation", ck)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
