"""Mixing sources to target weights by a multivariate-hypergeometric tree.

``plan``: each source's rows are dealt into blocks by a hash (block sizes near
``block_words``); a source's target is so many words, drawn as whole passes
over its blocks and one partial pass over blocks in the order of a keyed
permutation.  The exact numbers of blocks to draw, source by source, are the
root's quotas; a node splits its quotas among its two halves of the output
shards by a multivariate hypergeometric draw (seeded by the node), down to one
shard.  Shard k then owns a range of each source's permuted blocks, disjoint
from all others, and orders its rows by a hash: the local shuffle.

The last block drawn is taken row by row, in its local order, up to the exact
remainder, its last row in part; so a source's taken words are its target
rounded, and no row is taken more often than the passes begun, at most
``cap`` = 2 times.

Defined cases: a null source is a source of its own, last in order; null and
empty texts have size 0 and are taken as 0 words; a source with no words has
target 0; repeated rows are taken each on its own (they are numbered); an empty table gives no rows; extra columns are ignored unless asked for.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
BLOCK_WORDS, SHARDS, SEED = 20_000, 16, 11
BROADCAST_SOURCES, GROUP_SOURCES, MAX_GROUPS = 100_000, 4_096, 65_536
WORD = r"[^\x20\x09-\x0D]+"


def numbered_sources(sized: DataFrame) -> tuple[DataFrame, int]:
    """((sid, source, size), number of sources): one row per source, numbered in
    code-point order, null last; only a count per partition reaches the driver."""
    spark = sized.sparkSession
    sums = written(sized.groupBy("source").agg(F.sum("size").alias("size")), "sources")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = F.col("source").asc_nulls_last()
    rows = written(sums.repartitionByRange(parts, by).sortWithinPartitions(by)
                   .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered")
    n = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, at = [], 0
    for k in range(max(n, default=-1) + 1):
        first.append((k, at))
        at += n.get(k, 0)
    rows = rows.join(F.broadcast(spark.createDataFrame(first, "part int, first long")), "part")
    return rows.select((F.col("first") + F.col("at")).alias("sid"), "source", "size"), at


def with_targets(src: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``src`` with each source's target: shares of ``share`` times all words by
    weight; a target stops at ``cap`` times its source's size and the excess is
    shared anew until none is above.  Each round takes from the table, per weight,
    the exact words and number of the sources that stop."""
    kind, w = F.pmod("sid", F.lit(len(weights))), F.lit(0.0)
    for k, x in enumerate(weights):
        w = F.when(kind == k, F.lit(float(x))).otherwise(w)

    def sums(rows):
        return {r["k"]: (r["n"], r["size"]) for r in rows.groupBy(kind.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()}
    whole = sums(src)
    total, stopped, level = share * sum(x for _, x in whole.values()), {}, F.lit(0.0)
    while True:
        left = total - cap * sum(x for _, x in stopped.values())
        of = sum(weights[k] * (n - stopped.get(k, (0, 0))[0]) for k, (n, _) in whole.items())
        if not of:
            level = F.when(w > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)) if stopped else F.lit(0.0)
            break
        level = F.lit(float(left)) * w / F.lit(float(of))
        more = sums(src.filter(level > F.lit(float(cap)) * F.col("size")))
        if sum(n for n, _ in more.values()) <= sum(n for n, _ in stopped.values()):
            break
        stopped = more
    return src.withColumn("target", F.least(level, F.lit(float(cap)) * F.col("size")))


def _seed(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little")


def split_quotas(quotas: np.ndarray, shards: int, seed: int, totals: np.ndarray | None = None, key: tuple = ()) -> np.ndarray:
    """(shards x sources) block counts whose columns sum to ``quotas`` and whose
    rows sum to ``totals``, where given, or else are near to equal."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def down(q: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = q
            return
        mid = (lo + hi) // 2
        total = int(q.sum())
        take = round(total * (mid - lo) / (hi - lo)) if totals is None else int(totals[lo:mid].sum())
        rng = np.random.default_rng(_seed(seed, lo, hi, *key))
        left = np.zeros_like(q)
        rest = total
        for i, c in enumerate(q):        # the multivariate draw, one source after another
            got = _hypergeometric(rng, int(c), rest - int(c), take)
            left[i], rest, take = got, rest - int(c), take - got
        down(left, lo, mid)
        down(q - left, mid, hi)

    if shards:
        down(np.asarray(quotas, np.int64), 0, shards)
    return out


def dealt_quotas(quota: DataFrame, n_sources: int, shards: int, seed: int) -> DataFrame:
    """``quota`` (sid, n, quota) as (sid, blocks_of, ends): the splitting tree's
    cumulative counts.  The root's split is a draw among groups of sources, on the
    driver; given a group's counts, executors draw among its sources alone, which
    together is the one multivariate draw."""
    spark = quota.sparkSession
    per = max(GROUP_SOURCES, math.ceil(n_sources / MAX_GROUPS))
    n_groups = max(1, math.ceil(n_sources / per))
    quota = quota.withColumn("g", F.floor(F.col("sid") / per).cast("long"))
    sums = np.zeros(n_groups, np.int64)
    for r in quota.groupBy("g").agg(F.sum("quota").alias("n")).collect():
        sums[r["g"]] = r["n"]
    totals = spark.sparkContext.broadcast(split_quotas(sums, shards, seed))

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sid")
        g = int(rows["g"].iloc[0])
        out = split_quotas(rows["quota"].to_numpy(), shards, seed, totals.value[:, g], (g,) if n_groups > 1 else ())
        return pd.DataFrame({"sid": rows["sid"], "blocks_of": rows["n"], "ends": list(np.cumsum(out, axis=0).T)})
    return quota.groupBy("g").applyInPandas(deal, "sid long, blocks_of long, ends array<long>")


def _hypergeometric(rng, good: int, bad: int, sample: int) -> int:
    if not sample or not good:
        return 0
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, sample))
    n, p = good + bad, good / (good + bad)      # the normal limit beyond numpy's range
    sd = math.sqrt(sample * p * (1 - p) * (n - sample) / max(n - 1, 1))
    return int(min(max(round(rng.normal(sample * p, sd)), sample - bad, 0), good, sample))


def mix(df: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block_words: int = BLOCK_WORDS,
        shards: int = SHARDS, seed: int = SEED, keep: list[str] | None = None,
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: size, source_size, target, taken, and ``draws``, an
    array of (shard, position key, words) with one entry for each time the
    document is drawn.  Columns named in ``keep`` come along as ``__x0`` ..."""
    spark, keep = df.sparkSession, keep or []
    sized = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
                      F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                      F.xxhash64(F.col(text).cast("string")).alias("content"),
                      (F.xxhash64(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(0)).alias("kept"),
                      *(F.col(f"`{c}`").alias(f"__x{k}") for k, c in enumerate(keep)))
    if keep:
        sized = sized.withColumn("copy", F.lit(1))
    else:                                    # ids and numbers only; the texts are read once
        sized = (written(sized, "sizes").groupBy("doc_id", "source", "size", "content", "kept").agg(F.count(F.lit(1)).alias("n"))
                 .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n"))
    src, n_sources = numbered_sources(sized.select("source", "size"))
    small = F.broadcast if n_sources <= BROADCAST_SOURCES else (lambda x: x)      # beyond that, joined by source
    src = with_targets(src, weights, share, cap).select(
        "sid", "source", F.col("size").alias("source_size"), "target",
        F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(block_words))).cast("long").alias("n_blocks"))
    rows = (sized.alias("d").join(small(src).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
            .select("d.*", "s.sid", "s.source_size", "s.target", "s.n_blocks"))
    # a row's place follows from its content and, among equal rows, its number or kept columns, so reruns
    # agree; the kept columns move no other row, so mixes with and without them agree
    rows = (rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size", "content", "copy"))
            .withColumn("block", F.pmod(F.xxhash64(F.col("h"), F.lit(1)), F.col("n_blocks"))))
    # order of a source's blocks: a keyed permutation; words before each block, summed in two levels
    blocks = rows.groupBy("sid", "block").agg(F.sum("size").alias("words"))
    blocks = blocks.withColumn("perm", F.xxhash64(F.lit(seed), F.lit("perm"), F.pmod("sid", F.lit(2**31 - 1)).cast("int"), "block"))
    before = _running(blocks, ["sid"], ["perm", "block"], "words", "before", "place")
    tgt = src.select("sid", "source_size", "target")
    b = before.join(small(tgt), "sid")
    whole = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(F.lit(0))
    part = F.round("target").cast("long") - whole * F.col("source_size")
    b = (b.withColumn("whole", whole.cast("long")).withColumn("part", part.cast("long"))
         .withColumn("rest", F.greatest(F.lit(0), F.least(F.col("words"), F.col("part") - F.col("before"))).cast("long")))
    # quotas: blocks drawn, pass by pass; the tree deals them among the shards
    quota = b.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.max("whole").alias("whole"), F.sum((F.col("rest") > 0).cast("long")).alias("partial"))
    quota = written(quota.select("sid", "n", (F.col("n") * F.col("whole") + F.col("partial")).alias("quota")), "quotas")
    ends = dealt_quotas(quota, n_sources, shards, seed)
    b = b.join(small(ends), "sid").select("sid", "block", "words", "place", "blocks_of", "ends", "whole", "rest")
    inside = Window.partitionBy("sid", "block").orderBy("h", "doc_id", "content", "copy", "kept").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(b, ["sid", "block"])
    rows = rows.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead"))).cast("long"))
    shard = lambda p: F.size(F.filter("ends", lambda e: e <= p * F.col("blocks_of") + F.col("place"))).cast("int")
    full = F.transform(F.sequence(F.lit(0), F.col("whole").cast("int") - 1), lambda p: F.struct(
        shard(p).alias("shard"), F.xxhash64("h", p).alias("position"), F.col("size").alias("words")))
    last = F.array(F.struct(shard(F.col("whole")).alias("shard"), F.xxhash64("h", F.col("whole").cast("int")).alias("position"),
                            F.col("extra").alias("words")))
    kind = "array<struct<shard:int,position:bigint,words:bigint>>"
    none = F.array().cast(kind)
    rows = rows.withColumn("draws", F.concat(
        F.when((F.col("whole") > 0) & (F.col("size") > 0), full.cast(kind)).otherwise(none),
        F.when(F.col("extra") > 0, last.cast(kind)).otherwise(none)))
    return rows.select("doc_id", "size", "source_size", "target",
                       (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"), "draws",
                       *(f"__x{k}" for k in range(len(keep))))


def _running(df: DataFrame, by: list[str], order: list[str], value: str, name: str, place: str, buckets: int = 256) -> DataFrame:
    """Sum of ``value`` and number of rows before each row, within ``by`` along
    ``order`` (whose first column is a 64-bit hash): hash ranges are summed first, then rows inside a range."""
    cut = df.withColumn("__r", F.shiftright(F.col(order[0]), 64 - int(math.log2(buckets))))
    w = Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sums = (cut.groupBy(*by, "__r").agg(F.sum(value).alias("__v"), F.count(F.lit(1)).alias("__c"))
            .select(*by, "__r", F.coalesce(F.sum("__v").over(w), F.lit(0)).alias("__v0"), F.coalesce(F.sum("__c").over(w), F.lit(0)).alias("__c0")))
    u = Window.partitionBy(*by, "__r").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (cut.withColumn("__a", F.coalesce(F.sum(value).over(u), F.lit(0))).withColumn("__k", F.count(F.lit(1)).over(u))
            .join(sums, [*by, "__r"])
            .withColumn(name, F.col("__v0") + F.col("__a")).withColumn(place, F.col("__c0") + F.col("__k"))
            .drop("__r", "__v0", "__c0", "__a", "__k"))
