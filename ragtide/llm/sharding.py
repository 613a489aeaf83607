"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards.  A row descends it: at each node every
child draws ``-ln(u) / weight`` with u from the hash of the key and the child's
name, and the smallest draw wins, so a child gets rows in proportion to its
subtree's weight.  A subtree's draws depend on nothing outside it: when weights
change, only rows that enter or leave the changed subtrees move, and a subtree
that is added takes rows only into itself.

Law ``key``: the key and the number of shards decide.  ``layout(n)`` puts the
first shards in regions of ``RACKS x SHARDS`` and each further one in a region
of its own, so one more shard takes rows only into itself.

Defined cases: a null key is hashed like any other value (all null keys share
one shard); equal keys share a shard whatever their text; repeated rows get slots
of their own; a null text has size 1 and checksum 0, as an empty one; an empty
table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REGIONS, RACKS, SHARDS, SEED = 4, 2, 2, 7


def layout(n: int, weights: dict[int, float] | None = None) -> list[tuple[str, str, int, float]]:
    """(region, rack, shard, weight) of n shards."""
    base = REGIONS * RACKS * SHARDS
    out = []
    for s in range(n):
        region = s // (RACKS * SHARDS) if s < base else REGIONS + s - base
        rack = s % (RACKS * SHARDS) // SHARDS if s < base else 0
        out.append((f"region{region}", f"rack{rack}", s, (weights or {}).get(s, 1.0)))
    return [x for x in out if x[3] > 0]


def _pick(key: Column, children: Column) -> Column:
    """``at`` of the child (name, weight, at) with the smallest draw; equal draws go to the smaller ``at``."""
    def draw(c: Column) -> Column:
        u = (F.pmod(F.xxhash64(key, c["name"], F.lit(SEED)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.struct((-F.log(u) / c["weight"]).alias("draw"), c["at"].alias("at"))
    return F.array_min(F.transform(children, draw))["at"]


def tree_shard(key: Column, leaves: list[tuple[str, str, int, float]]) -> Column:
    """The shard of ``key`` (int): region, then rack, then shard."""
    regions: dict[str, float] = defaultdict(float)
    racks: dict[tuple[str, str], float] = defaultdict(float)
    for region, rack, _, w in leaves:
        regions[region] += w
        racks[region, rack] += w
    names, rack_names = list(regions), list(racks)

    def nodes(rows) -> Column:
        return F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(at).alias("at")) for n, w, at in rows))

    top = nodes((r, w, k) for k, (r, w) in enumerate(regions.items()))
    mid = F.array(*(nodes((f"{r}/{k}", racks[r, k], rack_names.index((r, k))) for q, k in rack_names if q == r) for r in names))
    low = F.array(*(nodes((f"{r}/{k}/{s}", w, s) for q, j, s, w in leaves if (q, j) == (r, k)) for r, k in rack_names))
    region = _pick(key, top)
    rack = _pick(key, F.element_at(mid, region + 1))
    return _pick(key, F.element_at(low, rack + 1)).cast("int")


def shard(df: DataFrame, n_shards: int = 16, doc_id: str = "doc_id", text: str = "text", blocks: int | None = None) -> DataFrame:
    """Every row's shard and its slot there.

    Slots are numbered in two levels: rows are cut into blocks by a hash,
    blocks are counted in a scan without the text and the counts summed along
    each shard, and rows are numbered inside (shard, block)."""
    spark = df.sparkSession
    blocks = blocks or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.col("doc_id")
    cols = [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("__text")]
    src = df.select(*cols).withColumn("__row", F.monotonically_increasing_id())
    src = (src.withColumn("shard", tree_shard(key, layout(n_shards)))
           .withColumn("grown_shard", tree_shard(key, layout(n_shards + 1)))
           .withColumn("__block", F.pmod(F.xxhash64("doc_id", "__row"), F.lit(blocks)).cast("int")))
    along = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = (src.groupBy("shard", "__block").agg(F.count(F.lit(1)).alias("n"))
              .select("shard", "__block", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before")))
    rows = src.select("doc_id", "__row", "shard", "grown_shard", "__block",
                      (F.coalesce(F.octet_length("__text"), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
                      F.crc32(F.coalesce(F.col("__text"), F.lit("")).cast("binary")).alias("text_crc32"))
    inside = Window.partitionBy("shard", "__block").orderBy("doc_id", "text_crc32", "__row")
    return (rows.withColumn("__k", F.row_number().over(inside))
            .join(before, ["shard", "__block"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("before") + F.col("__k") - 1).cast("long").alias("slot"), "grown_shard"))
