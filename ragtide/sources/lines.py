"""S1, S2, S3, A9 by line: text files of any size, read in byte ranges.

``files.read_text_files`` holds a file in one value.  Here Spark's text
reader cuts each file at ``maxPartitionBytes`` and carries a line over a
range's edge; lines end at ``\\n`` alone, so that every byte of the file is
accounted for, and carriage returns are resolved inside a line.  No UTF-8
sequence holds a line end, so a file is valid UTF-8 exactly if all its lines
are; that is reduced per file before any line is decoded, as latin-1 else.

The lines are stored once, as bytes.  Validity, numbering and totals come
from the small columns beside them (one row per byte range and file).

Defined cases: a zero-length file has no line and no row, nor has one that
holds a byte order mark alone; a byte order mark, which the reader drops,
stays the first line's first character, as text-mode reading keeps it
(uncompressed files); a last line without a line end counts; a folder
without a matching file gives empty tables; a line must fit in one value
(under 2 GB).  Columns of a partitioned folder are read as ``partitions``
declares them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragtide.functions.text import base_name, size_kb
from ragtide.session import shared_table

_BOM = b"\xef\xbb\xbf"


def _pieces(raw):
    """The lines inside one ``\\n``-ended record: its one trailing ``\\r`` belongs
    to the line end, every other one ends a line itself."""
    return F.split(F.regexp_replace(raw, "\r\\z", ""), "\r", -1)


def read_lines(spark: SparkSession, folder: str, pattern: str = "*.txt", recursive: bool = False,
               partitions: str = "") -> tuple[DataFrame, DataFrame]:
    """(lines, files) of the matching files.

    lines: path, record (0-based, by ``\\n``), part (0-based, by ``\\r`` inside the
    record), line; (path, record, part) is file order.  files: path, file,
    encoding, size_bytes, size_kb, lines (as ``readlines`` counts).  Both
    carry the partition columns."""
    fields = T.StructType.fromDDL(f"value string{', ' + partitions if partitions else ''}")
    keep = [f.name for f in fields if f.name != "value"]
    src = (spark.read.schema(fields).option("lineSep", "\n").option("pathGlobFilter", pattern)
           .option("recursiveFileLookup", str(recursive).lower()).text(folder))
    raw = src.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                     F.col("_metadata.file_size").alias("size"), *keep, F.col("value").cast("binary").alias("bytes"),
                     F.monotonically_increasing_id().alias("_m"), F.octet_length("value").cast("long").alias("_n"),
                     F.is_valid_utf8("value").alias("_ok"))
    # a carriage return is one byte in either encoding: counted on bytes read as latin-1
    stored = shared_table(raw.withColumn("_k", F.size(_pieces(F.decode("bytes", "ISO-8859-1"))).cast("long")), "lines")

    by_file = Window.partitionBy("path")
    # stored, so its size is known when the join is planned: broadcast below Spark's bound, else shuffled
    ranges = shared_table(stored.groupBy("path", "block", *keep)
                          .agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_rows"), F.sum("_n").alias("_bytes"),
                               F.max("size").alias("size"), F.min("_ok").alias("_ok"), F.sum("_k").alias("_lines"))
                          .withColumn("utf8", F.min("_ok").over(by_file))
                          .withColumn("_before", F.coalesce(F.sum("_rows").over(
                              by_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                          # bytes beyond lines and line ends: -1 without a last line end, three more with a dropped mark
                          .withColumn("bom", (F.max("size").over(by_file) - F.sum(F.col("_bytes") + F.col("_rows")).over(by_file)) >= 2), "ranges")
    files = (ranges.groupBy("path", *keep).agg(F.min("utf8").alias("utf8"), F.max("size").alias("size_bytes"),
                                               F.sum("_lines").cast("long").alias("lines"))
             .select("path", base_name("path").alias("file"), *keep,
                     F.when(F.col("utf8"), F.lit("utf-8")).otherwise(F.lit("latin-1")).alias("encoding"),
                     "size_bytes", size_kb("size_bytes").alias("size_kb"), "lines"))

    at = ranges.select("path", "block", "_first", "_before", "utf8", "bom")
    full = F.when(F.col("bom") & (F.col("_before") == 0) & (F.col("_m") == F.col("_first")),
                  F.concat(F.lit(bytearray(_BOM)), F.col("bytes"))).otherwise(F.col("bytes"))
    text = F.when(F.col("utf8"), F.decode("_b", "UTF-8")).otherwise(F.decode("_b", "ISO-8859-1"))
    lines = (stored.join(at, ["path", "block"]).withColumn("_b", full)
             .select("path", *keep, (F.col("_before") + F.col("_m") - F.col("_first")).alias("record"),
                     F.posexplode(_pieces(text)).alias("part", "line")))
    return lines, files


def line_documents(lines: DataFrame) -> DataFrame:
    """The lines as rows that ``chunking.split_lines`` takes: P2's line rules
    on lines that were read in ranges."""
    return lines.withColumnRenamed("line", "content")
