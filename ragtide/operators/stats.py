"""Corpus statistics (A1-A8), recent rows / previews.

Every statistic is a single aggregate pass with partial (map-side)
aggregation, so a file or type holding a third of all rows costs no more than
any other; top-N reports use ``orderBy().limit()`` (TakeOrderedAndProject).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtide.functions.text import (
    LENGTH_LABELS_FR, PREVIEW_STATS, is_blank, iso_timestamp, length_category, preview, rounded_avg_display,
)
from ragtide.operators.chunking import kept_chunks


def corpus_stats(corpus: DataFrame, text_col: str = "corpus") -> DataFrame:
    """A1, A2, A3, A5 in one scan: total_records, avg_length (2 decimals, 0 when
    empty), unique_files (NULL names ignored), first/last created_at."""
    agg = corpus.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.avg(F.length(text_col)).alias("_avg"),
        F.count_distinct("file_name").alias("unique_files"),
        F.min("created_at").alias("_first"),
        F.max("created_at").alias("_last"))
    return agg.select(
        "total_records",
        F.coalesce(F.round("_avg", 2), F.lit(0.0)).alias("avg_length"),
        "unique_files",
        iso_timestamp("_first").alias("first_created"),
        iso_timestamp("_last").alias("last_created"))


def stats_display(corpus: DataFrame, text_col: str = "corpus") -> DataFrame:
    """A1 + A2 as the statistics page shows them: the 2-decimal average and
    its display form, the nearest integer (P15)."""
    agg = corpus.agg(F.count(F.lit(1)).alias("total_records"), F.avg(F.length(text_col)).alias("_avg"))
    avg2 = F.coalesce(F.round("_avg", 2), F.lit(0.0))
    return agg.select("total_records", avg2.alias("avg_length"),
                      rounded_avg_display(avg2).alias("avg_length_display"))


def date_range(corpus: DataFrame) -> DataFrame:
    """A3: first and last insert time (ISO, NULL on an empty table)."""
    agg = corpus.agg(F.min("created_at").alias("_f"), F.max("created_at").alias("_l"))
    return agg.select(iso_timestamp("_f").alias("first"), iso_timestamp("_l").alias("last"))


def length_histogram(corpus: DataFrame, labels=LENGTH_LABELS_FR, text_col: str = "corpus") -> DataFrame:
    """Rows per length category, ordered by each group's shortest row.
    Empty categories are absent (a GROUP BY, as in the reference)."""
    return (corpus.select(F.length(text_col).alias("_len"),
                          length_category(text_col, labels).alias("category"))
            .groupBy("category")
            .agg(F.count(F.lit(1)).alias("count"), F.min("_len").cast("long").alias("min_length"))
            .orderBy("min_length"))


def type_counts(corpus: DataFrame) -> DataFrame:
    """Rows per file type, label upper-cased."""
    return (corpus.groupBy("file_type").agg(F.count(F.lit(1)).alias("count"))
            .select(F.upper("file_type").alias("file_type"), "count"))


def file_distribution(corpus: DataFrame, top: int = 10) -> DataFrame:
    """Exact rows per file, the ``top`` largest (count desc, name), with the
    reference's estimate total // n_files beside it.  The totals are scalar
    subqueries over the per-file aggregate (its exchange is reused), not a
    join; NULL file names count as rows but not as files."""
    per_file = corpus.groupBy("file_name").agg(F.count(F.lit(1)).alias("count"))
    total = per_file.select(F.sum("count")).scalar()
    n_files = per_file.select(F.count("file_name")).scalar()
    top_files = per_file.orderBy(F.col("count").desc(), F.col("file_name").asc()).limit(top)
    est = F.when(n_files > 0, F.floor(total / n_files)).otherwise(F.lit(0)).cast("long")
    return top_files.select("file_name", "count", est.alias("estimated_count"))


def ingest_summary(docs: DataFrame, content_col: str = "content") -> DataFrame:
    """Documents with text and their chunks per type, in one pass over the documents."""
    kept = docs.where(~is_blank(content_col))
    return (kept.groupBy(F.col("type").alias("file_type"))
            .agg(F.count(F.lit(1)).alias("documents"),
                 F.sum(F.size(kept_chunks(F.col(content_col)))).cast("long").alias("chunks")))


def recent_rows(corpus: DataFrame, n: int = 5, text_col: str = "corpus") -> DataFrame:
    """L2: the n most recent rows (created_at desc, id desc) with a 100-char
    preview and ISO date."""
    return (corpus.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)
            .select("id", preview(text_col, PREVIEW_STATS).alias("text"),
                    iso_timestamp("created_at").alias("date")))


def table_preview(corpus: DataFrame, n: int = 10, text_col: str = "corpus") -> DataFrame:
    """The first n rows by id with a 100-char preview."""
    return (corpus.orderBy("id").limit(n)
            .select("id", preview(text_col, PREVIEW_STATS).alias("corpus"),
                    iso_timestamp("created_at").alias("created_at")))
