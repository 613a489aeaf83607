"""W2 / W5 over a stored history: buckets of sessions with their newest rows at hand.

Folder ``rows`` holds every interaction and folder ``last`` each session's
newest ``HISTORY_LAST_N`` interactions with the session's count, both
partitioned by ``bucket`` (a hash of the session).  An append adds rows and
rewrites ``last`` for the buckets it reaches; clearing a session rewrites its
one bucket; the answer for a session reads one bucket of ``last``.  Rewrites
use dynamic partition overwrite.  A bucket left without rows keeps one row that is
not ``live``, for without it the overwrite would leave the old files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragtide.functions.text import iso_timestamp
from ragtide.operators.history import HISTORY_LAST_N
from ragtide.session import scratch_tables, shared_table

ROWS = "session_id bigint, seq bigint, query string, answer string, ts timestamp_ntz, live boolean"
COLUMNS = ("session_id", "seq", "query", "answer", "ts")


def _bucket(session, buckets: int):
    return F.pmod(F.xxhash64(session), F.lit(buckets)).cast("int")


def _put(df: DataFrame, path: str, mode: str) -> None:
    (df.repartition("bucket", F.pmod(F.xxhash64("session_id", "seq"), F.lit(16))).write.mode(mode)
     .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))


def _read(spark: SparkSession, path: str, folder: str, only=None) -> DataFrame:
    extra = ", count bigint" if folder == "last" else ""
    t = spark.read.schema(ROWS + extra + ", bucket int").parquet(f"{path}/{folder}")
    return t if only is None else t.where(F.col("bucket").isin(only))


def _newest(rows: DataFrame) -> DataFrame:
    """Each session's newest interactions (``row_number() <= N``: at most N rows of a session leave a task)."""
    w = Window.partitionBy("session_id").orderBy(F.col("seq").desc(), F.xxhash64("query", "answer", "ts"))
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= HISTORY_LAST_N).drop("_rn")


def _with_counts(newest: DataFrame, counts: DataFrame) -> DataFrame:
    c = counts.withColumnRenamed("session_id", "_s")
    return newest.join(c, newest["session_id"].eqNullSafe(c["_s"])).drop("_s")


def _counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("count"))


def write_history(history: DataFrame, path: str, buckets: int) -> None:
    """The table at ``path`` made of ``history`` (session_id, seq, query, answer, ts)."""
    rows = history.select(*COLUMNS, F.lit(True).alias("live"), _bucket("session_id", buckets).alias("bucket"))
    rows.repartition("bucket", F.pmod(F.xxhash64("session_id", "seq"), F.lit(16))).write.partitionBy("bucket").parquet(f"{path}/rows")
    stored = _read(history.sparkSession, path, "rows")
    _with_counts(_newest(stored), _counts(stored)).write.partitionBy("bucket").parquet(f"{path}/last")


def append_history(history: DataFrame, path: str, buckets: int) -> None:
    """More interactions.  ``last`` is merged from its own rows and the new ones alone;
    the stored rows are not read.  An append whose rows were written but that stopped before ``last``
    was is completed by ``rebuild_last``, not by running it again."""
    spark = history.sparkSession
    with scratch_tables(spark):
        new = shared_table(history.select(*COLUMNS, F.lit(True).alias("live"), _bucket("session_id", buckets).alias("bucket")), "turns")
        reached = [r[0] for r in new.select("bucket").distinct().collect()]          # at most one per bucket
        old = _read(spark, path, "last", reached).where("live")
        counts = old.groupBy("session_id").agg(F.max("count").alias("count")).unionByName(_counts(new)) \
            .groupBy("session_id").agg(F.sum("count").alias("count"))
        merged = shared_table(_with_counts(_newest(old.drop("count").unionByName(new)), counts), "last")
        _put(new, f"{path}/rows", "append")
        _put(merged, f"{path}/last", "overwrite")


def rebuild_last(spark: SparkSession, path: str) -> None:
    """``last`` made anew from all rows."""
    stored = _read(spark, path, "rows").where("live")
    _put(_with_counts(_newest(stored), _counts(stored)), f"{path}/last", "overwrite")


def clear_session(spark: SparkSession, path: str, session_id: int, buckets: int) -> None:
    """The session removed; only its bucket is read and written.  ``last`` goes first: a clear that stops in
    between is completed by running it again.  Sessions without an id stay."""
    b = spark.range(1).select(_bucket(F.lit(session_id).cast("long"), buckets)).first()[0]
    with scratch_tables(spark):
        for folder in ("last", "rows"):
            t = _read(spark, path, folder, [b])
            kept = t.where(F.col("live") & ~F.col("session_id").eqNullSafe(F.lit(session_id)))
            mark = spark.range(1).select(*[(F.lit(False) if f.name == "live" else F.lit(b) if f.name == "bucket" else F.lit(None))
                                           .cast(f.dataType).alias(f.name) for f in t.schema])
            _put(shared_table(kept.unionByName(mark), folder), f"{path}/{folder}", "overwrite")


def last_n(spark: SparkSession, path: str, n: int = HISTORY_LAST_N, *, session_id: int | None = None, buckets: int | None = None) -> DataFrame:
    """W2 from ``last`` alone: (session_id, position, seq, query, answer, timestamp, count), as
    ``history.history_last_n``; of one session (with ``buckets``) from its bucket.  n is ``HISTORY_LAST_N`` at most."""
    if n > HISTORY_LAST_N:
        raise ValueError(f"the newest {HISTORY_LAST_N} interactions are at hand; ask history_last_n over the rows for {n}")
    t = _read(spark, path, "last").where("live")
    if session_id is not None:
        t = t.where((F.col("session_id") == session_id) & (F.col("bucket") == _bucket(F.lit(session_id).cast("long"), buckets)))
    w = Window.partitionBy("session_id").orderBy(F.col("seq").desc(), F.xxhash64("query", "answer", "ts"))
    t = t.where(F.col("session_id").isNotNull()).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return t.select("session_id", (F.least("count", F.lit(n)) - F.col("_rn") + 1).cast("long").alias("position"), "seq", "query",
                    "answer", iso_timestamp("ts").alias("timestamp"), "count")


def all_rows(spark: SparkSession, path: str) -> DataFrame:
    """Every stored interaction."""
    return _read(spark, path, "rows").where("live").select(*COLUMNS)
