"""The trie of shared conversation prefixes, its subtree totals by parallel tree contraction.

``ordered`` numbers each conversation's turns.  ``Trie`` names every prefix by its
depth and two 64-bit sums (exclusive or) of its turns' hashes by place; equal prefixes are one
node.  The subtree totals are found in rounds of joins:

* rake: every leaf gives its total to its parent and leaves the tree;
* compress: of the inner nodes with one child, those with a larger random number than their
  neighbours of that kind leave; the child moves up to the parent and carries along what the node had;
* when the root alone is left, the rounds are run backwards: a node that
  compress took out has its child's total and what it had itself.

A round takes away all leaves and about a third of every unary chain, so the number of
rounds grows with the logarithm of the tree, whatever its depth.  Each round's
tree is written to the shared folder.

No group is collected: long conversations are numbered over ranges of turns and their
prefixes summed in blocks of ``BLOCK`` turns, block totals in blocks again;
parents of very many children (at most 1,000 hold more than a thousandth of all nodes) reach their children
by a broadcast.

Defined cases: turns stand in the order of turn (null first), role, text; a null role or text is
an empty one; rows without conv_id belong to no conversation; a conversation without
turns ends at the root; repeated rows are turns of their own; an empty table gives no
nodes; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

BLOCK = 1024
HOT = 1_000                       # a key with more than 1 / HOT of the rows is joined by broadcast: at most HOT keys
PIECE = 10_000                    # members hashed from one string
KEY = ["depth", "k1", "k2"]


def ordered(df: DataFrame) -> DataFrame:
    """(conv_id, pos, t1, t2, bytes): each turn's place from 0, two hashes of (role, text), and the text's bytes.

    Turns are sorted over ranges, so a conversation may lie in several; a row
    per range tells how many turns of its first conversation came before."""
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    src = df.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = (src.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
              .select("conv_id", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(71), "text", "role").alias("t2"), F.octet_length("text").cast("long").alias("bytes")))

    def number(batches):
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column("conv_id").to_numpy()
            if not len(conv):
                continue
            first = np.flatnonzero(np.diff(conv, prepend=conv[0] + 1 if last is None else last))
            at = np.arange(len(conv))
            begin = np.zeros(len(conv), np.int64)
            begin[first] = first
            pos = at - np.maximum.accumulate(begin)
            upto = first[0] if len(first) else len(conv)        # these rows go on with the last batch's conversation
            pos[:upto] = n + at[:upto]
            last, n = conv[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(conv), part, np.int32)), pa.array(pos)],
                                             names=[*batch.schema.names, "part", "pos"])

    rows = written(hashed.mapInArrow(number, "conv_id long, t1 long, t2 long, bytes long, part int, pos long"), "turns")
    ends = rows.groupBy("part").agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi"), F.max(F.struct("conv_id", "pos")).alias("last"))
    carry, conv, have = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r["part"]):       # a row per range
        had = have if r["lo"] == conv else 0
        if had:
            carry.append((r["part"], r["lo"], had))
        conv, have = r["hi"], r["last"]["pos"] + 1 + (had if r["lo"] == r["hi"] else 0)
    more = df.sparkSession.createDataFrame(carry, "part int, conv_id long, more long")
    out = rows.join(F.broadcast(more), ["part", "conv_id"], "left")
    return out.select("conv_id", (F.col("pos") + F.coalesce("more", F.lit(0))).alias("pos"), "t1", "t2", "bytes")


def joined(left: DataFrame, right: DataFrame, key: list[str], hot: DataFrame) -> DataFrame:
    """``left`` with the columns of ``right`` (one row per key) of its key, inner.  ``hot``: the keys of very many left rows, at most HOT."""
    few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    rest = left.join(F.broadcast(hot), key, "left_anti")
    return left.join(few, key).unionByName(rest.join(right, key))


def hot_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """The keys with more than one row in HOT."""
    n = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n")).first()[0] or 0
    return n.filter(F.col("n") * HOT > total).select(*key)


def _before(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, x1, x2) with p1, p2: the sums of all smaller places of the conversation."""
    w = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocked = rows.withColumn("block", F.floor(F.col("pos") / BLOCK))
    run = blocked.select("*", *(F.bit_xor(f"x{k}").over(w).bitwiseXOR(F.col(f"x{k}")).alias(f"p{k}") for k in (1, 2)))
    if (rows.agg(F.max("pos")).first()[0] or 0) < BLOCK:
        return run.drop("block")
    sums = written(blocked.groupBy("conv_id", F.col("block").alias("pos")).agg(*(F.bit_xor(f"x{k}").alias(f"x{k}") for k in (1, 2))), "blocks")
    upto = _before(sums).filter("pos > 0").select("conv_id", F.col("pos").alias("block"), F.col("p1").alias("b1"), F.col("p2").alias("b2"))
    # the rows of one block are few, so no key of this join is hot
    return run.join(upto, ["conv_id", "block"], "left").select(
        *rows.columns, *(F.col(f"p{k}").bitwiseXOR(F.coalesce(f"b{k}", F.lit(0))).alias(f"p{k}") for k in (1, 2)))


class Trie:
    """The trie of the turns (conv_id, pos, t1, t2, bytes; pos from 0 without gaps) of the
    conversations ``convs`` (conv_id, distinct; those without turns too).

    ``nodes``: depth, k1, k2 (the node's name), conv_id (its smallest member),
    parent_conv_id, n_convs, n_children, n_leaves, saved.  ``ends``: depth, k1, k2 and conv_id of
    every conversation: the node where it ends."""

    def __init__(self, turns: DataFrame, convs: DataFrame):
        rows = turns.select("conv_id", "pos", "bytes", F.xxhash64("pos", "t1", "t2").alias("x1"), F.xxhash64(F.lit(73), "t2", "t1", "pos").alias("x2"))
        rows = _before(written(rows, "hashed")).select(
            "conv_id", (F.col("pos") + 1).alias("depth"), "bytes", "p1", "p2", F.col("p1").bitwiseXOR(F.col("x1")).alias("k1"),
            F.col("p2").bitwiseXOR(F.col("x2")).alias("k2"))
        rows = written(rows, "prefixes")
        last = rows.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("m")).select("conv_id", "m.*")
        zero = F.lit(0).cast("long")
        self.ends = written(convs.join(last, "conv_id", "left").select(*(F.coalesce(c, zero).alias(c) for c in KEY), "conv_id"), "ends")
        named = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"),
                                       F.max("p1").alias("p1"), F.max("p2").alias("p2"))
        root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
            *(zero.alias(c) for c in KEY), "conv_id", "n_convs", *(zero.alias(c) for c in ("bytes", "p1", "p2")))
        nodes = written(named.unionByName(root).withColumn("nid", F.monotonically_increasing_id()), "nodes")
        up = nodes.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.col("nid").alias("child"))
        up = joined(up, nodes.select(*KEY, F.col("nid").alias("pid"), F.col("conv_id").alias("parent_conv_id")), KEY, hot_keys(up, KEY))
        up = written(up.select("child", "pid", "parent_conv_id"), "parents")
        kids = up.groupBy(F.col("pid").alias("nid")).agg(F.count(F.lit(1)).alias("n_children"))
        tree = (nodes.join(up.withColumnRenamed("child", "nid"), "nid", "left").join(kids, "nid", "left")
                .withColumn("n_children", F.coalesce("n_children", zero)))
        tree = written(tree.drop("p1", "p2"), "tree")
        weights = tree.select("nid", "pid", F.col("n_children").alias("kids"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("a1"),
                              ((F.col("n_convs") - 1) * F.col("bytes")).alias("a2"))
        totals = subtree_totals(weights).select("nid", F.col("a1").alias("n_leaves"), F.col("a2").alias("saved"))
        self.nodes = tree.join(totals, "nid").select(*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved")


def subtree_totals(tree: DataFrame) -> DataFrame:
    """(nid, a1, a2): each node's weights (a1, a2) summed over its subtree.  ``tree``: nid (distinct), pid
    (null: a root), kids (number of children), a1, a2; several roots are several trees."""
    zero = F.lit(0).cast("long")
    state = written(tree.select("*", zero.alias("e1"), zero.alias("e2")), "round-0")       # e: of nodes taken out between it and its parent
    rounds = []
    while not state.filter("kids > 0").isEmpty():
        k = len(rounds) + 1
        leaf = (F.col("kids") == 0) & F.col("pid").isNotNull()
        up = state.filter("pid is not null").groupBy(F.col("pid").alias("nid")).agg(
            F.sum(F.when(leaf, 1).otherwise(0)).alias("raked"), F.max(F.when(~leaf, F.col("nid"))).alias("child"),
            *(F.sum(F.when(leaf, F.col(f"a{j}") + F.col(f"e{j}")).otherwise(0)).alias(f"g{j}") for j in (1, 2)))
        raked = state.filter(~leaf).join(up, "nid", "left").select(
            "nid", "pid", (F.col("kids") - F.coalesce("raked", zero)).alias("kids"), "child",
            *((F.col(f"a{j}") + F.coalesce(f"g{j}", zero)).alias(f"a{j}") for j in (1, 2)), "e1", "e2")
        raked = written(raked, f"raked-{k}")
        nxt = written(_compressed(raked, k), f"round-{k}")
        rounds.append((state.filter(leaf).select("nid", "a1", "a2"), nxt))
        state = nxt.select("nid", "pid", "kids", "a1", "a2", "e1", "e2")
    totals = state.select("nid", "a1", "a2")
    for k, (leaves, nxt) in reversed(list(enumerate(rounds, 1))):
        out = nxt.filter("out is not null").select(F.col("out").alias("nid"), F.col("nid").alias("child"), "o1", "o2")
        below = totals.select(F.col("nid").alias("child"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        out = out.join(below, "child").select("nid", *((F.col(f"o{j}") + F.col(f"b{j}")).alias(f"a{j}") for j in (1, 2)))
        totals = written(totals.unionByName(leaves).unionByName(out), f"totals-{k}")
    return totals


def _compressed(tree: DataFrame, k: int) -> DataFrame:
    """The tree without the unary nodes taken out in round k.  Where a node's parent went, ``out`` names it and
    o1, o2 are what its total has beyond this node's."""
    chance = lambda c: F.xxhash64(F.lit(k), c)
    unary = (F.col("kids") == 1) & F.col("pid").isNotNull()
    # every join key is a node, once on either side
    above = tree.filter(unary).select(F.col("child").alias("nid"), F.col("nid").alias("above"))
    seen = tree.join(above, "nid", "left")
    below = seen.filter(unary & F.col("above").isNotNull()).select(F.col("above").alias("nid"), F.col("nid").alias("below"))
    seen = seen.join(below, "nid", "left")
    goes = unary & (F.col("above").isNull() | (chance("nid") > chance("above"))) & (F.col("below").isNull() | (chance("nid") > chance("below")))
    seen = seen.withColumn("goes", F.coalesce(goes, F.lit(False)))
    gone = seen.filter("goes").select(F.col("child").alias("nid"), F.col("nid").alias("out"), F.col("pid").alias("top"),
                                      *(F.col(f"{c}{j}").alias(f"{c}{j}_") for c in "ae" for j in (1, 2)))
    kept = seen.filter("not goes").join(gone, "nid", "left")
    zero = F.lit(0).cast("long")
    return kept.select(
        "nid", F.when(F.col("out").isNotNull(), F.col("top")).otherwise(F.col("pid")).alias("pid"), "kids", "a1", "a2",
        *((F.col(f"e{j}") + F.coalesce(F.col(f"a{j}_") + F.col(f"e{j}_"), zero)).alias(f"e{j}") for j in (1, 2)),
        "out", *((F.col(f"e{j}") + F.col(f"a{j}_")).alias(f"o{j}") for j in (1, 2)))


def members_sha256(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, sha): SHA-256 of the ends' conv_ids of every node that has some, ascending, joined by commas.

    The ids are sorted over ranges and become strings of at most ``PIECE`` ids there; a node's
    strings are hashed in order, a string at a time."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [*KEY, "part", "piece", "ids"]

    def pieces(batches):
        part, piece, key, ids = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            rows: list = []
            for *k, c in zip(*(batch.column(x).to_pylist() for x in (*KEY, "conv_id"))):
                if ids and (k != key or len(ids) == PIECE):
                    rows.append((*key, part, piece, ",".join(ids)))
                    piece, ids = piece + 1, []
                key = k
                ids.append(str(c))
            if rows:
                yield _batch(rows, names)
        if ids:
            yield _batch([(*key, part, piece, ",".join(ids))], names)

    def digests(batches):
        key, sha = None, None
        for batch in batches:
            rows = []
            for *k, ids in zip(*(batch.column(x).to_pylist() for x in (*KEY, "ids"))):
                if k != key:
                    if sha is not None:
                        rows.append((*key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if rows:
                yield _batch(rows, [*KEY, "sha"])
        if sha is not None:
            yield _batch([(*key, sha.hexdigest())], [*KEY, "sha"])

    order = [*KEY, "conv_id"]
    cut = ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
        pieces, "depth long, k1 long, k2 long, part int, piece int, ids string")
    return cut.repartition(*KEY).sortWithinPartitions(*KEY, "part", "piece").mapInArrow(digests, "depth long, k1 long, k2 long, sha string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    typ = {"part": pa.int32(), "piece": pa.int32(), "ids": pa.string(), "sha": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, typ.get(n, pa.int64())) for c, n in zip(zip(*rows), names)], names=names)
