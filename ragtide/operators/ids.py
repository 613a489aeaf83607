"""Dense serial ids 1..N in a given order, without a global window.

A global ``row_number() OVER (ORDER BY ...)`` pulls every row into one task;
``monotonically_increasing_id`` alone leaves gaps.  Two forms:

``in_order`` and ``stored_ids`` (used for chunk ids): documents go to ranges
of their key and are sorted there, their chunks are cut once and stored with
task number and place, and the rows per task turn these into dense ids while
the table is read.  The key may be any sortable type.

``dense_index`` (any rows with a numeric split key monotone in the order):

1. one approximate-quantile pass gives at most ``num_ranges - 1`` bounds;
   they return to the driver as a bounded list and enter the plan as
   literals, so every branch and every recomputed task sees the same ranges
   (range sampling inside the plan is seeded per RDD and could differ
   between branches);
2. ``Bucketizer`` (JVM-side binary search) maps each row to its range;
3. row counts per range (a partial aggregate, one row per range) give each
   range its start offset through a running sum over that small frame, which
   is broadcast back (size bounded by ``num_ranges``);
4. rows are hash-partitioned by range and numbered inside it with
   ``row_number``; the window reuses that partitioning (no second shuffle).
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragtide.session import shared_table


def range_bounds(df: DataFrame, key: Column, n: int, accuracy: int = 10000) -> list[float]:
    """At most n-1 distinct approximate quantiles of a numeric key (one
    aggregate pass; only the key's columns are read)."""
    probs = [i / n for i in range(1, n)]
    if not probs:
        return []
    row = df.agg(F.percentile_approx(key.cast("double"), probs, accuracy).alias("q")).collect()[0]
    return sorted({float(x) for x in (row["q"] or []) if x is not None})


def dense_index(df: DataFrame, order_cols: list[str | Column], id_col: str = "id",
                num_ranges: int | None = None, split_key: Column | None = None,
                bounds: list[float] | None = None, accuracy: int = 10000) -> DataFrame:
    """Add ``id_col`` = 1-based position of each row in ``order_cols`` order.

    ``split_key`` must be numeric and non-decreasing in that order (default:
    the first order column).  ``bounds`` may be given (e.g. from a cheaper
    table than ``df``); any sorted bounds give correct ids, good ones balance
    the ranges.  The order key must be unique for the ids to be
    deterministic."""
    spark = df.sparkSession
    n = num_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = order_cols[0]
    sk = (split_key if split_key is not None else (F.col(first) if isinstance(first, str) else first))
    keyed = df.withColumn("_sk", sk.cast("double"))
    if bounds is None:
        bounds = range_bounds(df, sk, n, accuracy)
    bounds = sorted(set(bounds))
    if bounds:
        splits = [float("-inf")] + bounds + [float("inf")]
        bucketed = Bucketizer(splits=splits, inputCol="_sk", outputCol="_b", handleInvalid="keep") \
            .transform(keyed)
        bucketed = bucketed.withColumn("_b", F.col("_b").cast("int"))
    else:                      # no data or a single key value: one range
        bucketed = keyed.withColumn("_b", F.lit(0))
    sizes = bucketed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range: a running sum over this frame is tiny
    w_off = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_off"))
    w_in = Window.partitionBy("_b").orderBy(*order_cols)
    numbered = (bucketed.repartition(n, "_b")
                .withColumn("_rn", F.row_number().over(w_in)))
    out = numbered.join(F.broadcast(offsets), "_b", "inner")
    return (out.withColumn(id_col, (F.col("_off") + F.col("_rn")).cast("long"))
            .drop("_sk", "_b", "_rn", "_off"))


def in_order(df: DataFrame, order_cols: list[str], ties: list[str], num_ranges: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted: partition by partition, row by row in ``order_cols``, ``ties`` order.

    With one numeric key the bounds are quantiles of that column, read alone,
    and a row goes to its range by number.  For other keys, or where one key
    value fills more than a range, Spark samples the ranges over key and
    ties, so equal keys are split too (its sampling reads the rows once more)."""
    n = num_ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = order_cols[0]
    if len(order_cols) == 1 and n > 1 and isinstance(df.schema[key].dataType, T.NumericType):
        sk = F.coalesce(F.col(key).cast("double"), F.lit(float("-inf")))
        q = df.agg(F.percentile_approx(sk, [i / n for i in range(1, n)], 100 * n).alias("q")).first()["q"] or []
        if q and q[0] > float("-inf") and all(a < b for a, b in zip(q, q[1:])):
            placed = Bucketizer(splits=[float("-inf"), *q, float("inf")], inputCol="_sk", outputCol="_b",
                                handleInvalid="keep").transform(df.withColumn("_sk", sk))
            return (placed.repartitionById(n + 1, F.col("_b").cast("int")).drop("_sk", "_b")
                    .sortWithinPartitions(key, *ties))
    return df.repartitionByRange(n, *order_cols, *ties).sortWithinPartitions(*order_cols, *ties)


def stored_ids(ordered: DataFrame, id_col: str, name: str) -> DataFrame:
    """The rows of ``ordered`` (see ``in_order``; narrow steps may follow it) with ids 1..N in that order, stored.

    The rows are computed once and written with the number of their task and
    their place in it.  Rows per task, counted from that one stored column,
    give each task's first id (one small row per task reaches the driver), and
    ids are added while reading: nothing is sorted, joined by key or computed twice."""
    spark = ordered.sparkSession
    stored = shared_table(ordered.withColumn("_m", F.monotonically_increasing_id()), name)
    task = F.shiftright("_m", 33).cast("int")
    sizes = stored.groupBy(task.alias("_t")).count().collect()              # one row per write task
    starts, at = [], 0
    for t, size in sorted(map(tuple, sizes)):
        starts.append((t, at))
        at += size
    first = F.broadcast(spark.createDataFrame(starts, "_t int, _first long"))
    place = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    out = stored.withColumn("_t", task).join(first, "_t")
    return out.select((F.col("_first") + place + 1).alias(id_col), *[c for c in ordered.columns])
