"""Parquet table scans (S6) and the stand-ins that map the test tables onto the
reference's data model.

Stand-ins (fixed by the build plan):
* a document is a source file: ``source`` -> file_name, ``lang`` -> file_type;
* created_at of a document's rows = 2024-01-01 00:00:00 + doc_id seconds;
* a chat interaction is a user turn followed by the assistant turn right after.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
CREATED_AT_EPOCH = "2024-01-01 00:00:00"
# ----------------------------------------------------------------------------

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


# Declared schemas of the tables the queries read: a read with a schema
# launches no footer-inference job.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if name in SCHEMAS:
        return spark.read.schema(SCHEMAS[name]).parquet(path)
    return spark.read.parquet(path)


def spread(df: DataFrame, key: str, min_partitions: int | None = None) -> DataFrame:
    """Hash-spread a scan that yields fewer splits than the cluster has cores
    (a single-row-group file is one task however large it is).  A large
    input already has many splits and is returned unchanged, so this never
    adds a shuffle at scale.  Hashing on the key keeps a recomputed task's
    rows identical."""
    spark = df.sparkSession
    try:
        want = min_partitions or spark.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:          # sessions without RDD access: leave the scan as it is
        return df
    if have >= want:
        return df
    return df.repartition(want, key)


def created_at_for(doc_id_col) -> "F.Column":
    """Derived insert time as TIMESTAMP_NTZ."""
    return (F.to_timestamp_ntz(F.lit(CREATED_AT_EPOCH))
            + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col(doc_id_col).cast("decimal(18,6)")))


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document table in the reference's document-record shape:
    (doc_id, file, content, type, created_at)."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    return d.select(F.col("doc_id").cast("long").alias("doc_id"),
                    F.col("source").alias("file"),
                    F.col("text").alias("content"),
                    F.col("lang").alias("type"),
                    created_at_for("doc_id").alias("created_at"))


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors (S6): (id, embedding array<float>, label)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("long").alias("id"), "embedding", "label")
