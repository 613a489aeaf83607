"""A1-A7 on a growing table: one small state row per (file, type, length category)
of each appended load, merged on read.

The states hold counts, sums, minima and maxima, which add up over loads, and
the file names themselves, so distinct files are exact.  They are partitioned
by load and written like the corpus (``ingest.write_load``): a load that runs
again replaces its states.  No report reads a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragtide.functions.text import LENGTH_LABELS_FR, iso_timestamp, length_category, rounded_avg_display

STATE_SCHEMA = ("file_name string, file_type string, category string, rows bigint, length_sum bigint, length_min bigint, "
                "first timestamp_ntz, last timestamp_ntz, load string")


def load_states(corpus: DataFrame, text_col: str = "corpus") -> DataFrame:
    """The states of one load's corpus rows (a partial aggregate: a file with a third of all rows is no hot key).
    NULL names and types are keys of their own; a NULL text counts as a row of no length and no category."""
    c = corpus.select("file_name", "file_type", "created_at", F.length(text_col).cast("long").alias("_n"),
                      F.when(F.col(text_col).isNotNull(), length_category(text_col, LENGTH_LABELS_FR)).alias("category"))
    return c.groupBy("file_name", "file_type", "category").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("_n").alias("length_sum"), F.min("_n").alias("length_min"),
        F.min("created_at").alias("first"), F.max("created_at").alias("last"))


def write_states(corpus: DataFrame, path: str, load: str) -> None:
    """The states of load ``load``, in place of those it wrote before."""
    (load_states(corpus).withColumn("load", F.lit(load)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(path))


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATE_SCHEMA).parquet(path)


def _average(states: DataFrame):
    """Sum of lengths over the rows that have one, 2 decimals; 0 on an empty table."""
    known = F.sum(F.when(F.col("category").isNotNull(), F.col("rows")))
    return F.coalesce(F.round(F.sum("length_sum") / known, 2), F.lit(0.0))


def corpus_stats(states: DataFrame) -> DataFrame:
    """A1, A2, A3, A5 as ``stats.corpus_stats``."""
    a = states.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total_records"), _average(states).alias("avg_length"),
                   F.count_distinct("file_name").alias("unique_files"), F.min("first").alias("_f"), F.max("last").alias("_l"))
    return a.select("total_records", "avg_length", "unique_files", iso_timestamp("_f").alias("first_created"),
                    iso_timestamp("_l").alias("last_created"))


def stats_display(states: DataFrame) -> DataFrame:
    """A1 + A2 + P15 as ``stats.stats_display``."""
    a = states.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total_records"), _average(states).alias("avg_length"))
    return a.withColumn("avg_length_display", rounded_avg_display("avg_length"))


def length_histogram(states: DataFrame, labels=LENGTH_LABELS_FR) -> DataFrame:
    """A4 as ``stats.length_histogram``, under any labels of the same bounds."""
    shown = F.element_at(F.create_map(*[F.lit(x) for pair in zip(LENGTH_LABELS_FR, labels) for x in pair]), F.col("category"))
    return (states.where(F.col("category").isNotNull()).groupBy(shown.alias("category"))
            .agg(F.sum("rows").alias("count"), F.min("length_min").alias("min_length")).orderBy("min_length"))


def type_counts(states: DataFrame) -> DataFrame:
    """A6 as ``stats.type_counts``."""
    return (states.groupBy("file_type").agg(F.sum("rows").alias("count"))
            .select(F.upper("file_type").alias("file_type"), "count"))


def file_distribution(states: DataFrame, top: int = 10) -> DataFrame:
    """A7 as ``stats.file_distribution``."""
    per = states.groupBy("file_name").agg(F.sum("rows").alias("count"))
    total, files = per.select(F.sum("count")).scalar(), per.select(F.count("file_name")).scalar()
    est = F.when(files > 0, F.floor(total / files)).otherwise(F.lit(0)).cast("long")
    return (per.orderBy(F.col("count").desc(), F.col("file_name").asc()).limit(top)
            .select("file_name", "count", est.alias("estimated_count")))
