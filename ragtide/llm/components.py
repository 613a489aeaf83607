"""Connected components of an edge table, by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _state(e: DataFrame):
    return e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp) of every node that has an edge to another one; ``comp`` is the
    smallest node of its component.  ``edges`` has long columns a and b.

    Large-star and small-star rounds: each turns the edges of a node towards
    the smallest one around it, until only stars are left.  A node of very many
    edges meets them in an aggregate and in a join that Spark can split;
    each round's edges are written to the shared folder."""
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    before = _state(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e1 = (both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
              .filter("a <> b").distinct())
        low = e1.groupBy("a").agg(F.min("b").alias("m"))
        j = e1.join(low, "a")
        e2 = (j.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
              .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        e = written(e2, "edges")
        state = _state(e)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
