"""Text-file sources: S1 folder scan, S2 decode fallback, S3 newline
normalisation, A9/L4 file inventory.

``binaryFile`` gives one row per file with its bytes, so the utf-8 /
latin-1 choice is made per file on the executors (JVM-side).
``binaryFile`` yields no row for a zero-length file; they are never
ingested anyway, and the inventory adds them back from the scan's file
listing (``inputFiles()``, which Spark's file index holds already) with
size 0 and 0 lines, as the reference lists them.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragtide.functions.text import (
    base_name, decode_fallback, line_count, normalize_newlines, py_strip, size_kb,
)


def read_text_files(spark: SparkSession, folder: str, pattern: str = "*.txt",
                    recursive: bool = False) -> DataFrame:
    """(path, file, text, size_bytes): each matching file decoded (utf-8, else
    latin-1) with newlines normalised as text-mode reading does."""
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
           .option("recursiveFileLookup", str(recursive).lower()).load(folder))
    return raw.select("path", base_name("path").alias("file"),
                      normalize_newlines(decode_fallback("content")).alias("text"),
                      F.col("length").alias("size_bytes"))


def load_documents(spark: SparkSession, folder: str, file_type: str = "txt",
                   pattern: str | None = None) -> DataFrame:
    """One document per file, content stripped, blank files dropped:
    (file, content, type)."""
    f = read_text_files(spark, folder, pattern or f"*.{file_type}")
    return (f.select("file", py_strip("text").alias("content"), F.lit(file_type).alias("type"))
            .where(F.col("content") != ""))


def _same_path(c):
    """``file:///x`` and ``file:/x`` name the same file: one form for both."""
    return F.regexp_replace(c, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def file_inventory(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """A9 + L4: per file name, size in KB (2 decimals) and line count, ordered
    by size descending (name breaks ties).  Zero-length files are listed
    with size 0 and 0 lines."""
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
           .option("recursiveFileLookup", "false").load(folder))
    f = read_text_files(spark, folder, pattern)
    listed = spark.createDataFrame([(unquote(p),) for p in raw.inputFiles()], "path string")
    empty = (listed.join(f.select(_same_path("path").alias("_p")), _same_path(listed["path"]) == F.col("_p"),
                         "left_anti")
             .select(base_name("path").alias("file"), F.lit("").alias("text"), F.lit(0).cast("long")
                     .alias("size_bytes")))
    allf = f.select("file", "text", "size_bytes").unionByName(empty)
    return (allf.select(F.col("file").alias("name"), size_kb("size_bytes").alias("size_kb"),
                        line_count("text").alias("lines"))
            .orderBy(F.col("size_kb").desc(), F.col("name").asc()))


def inventory_totals(inventory: DataFrame) -> DataFrame:
    """A9 totals: number of files and of lines (one aggregate)."""
    return inventory.agg(F.count(F.lit(1)).alias("total_files"),
                         F.coalesce(F.sum("lines"), F.lit(0)).cast("long").alias("total_lines"))
