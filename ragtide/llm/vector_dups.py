"""Near-duplicate vectors by lattice hashing.

A unit vector is projected at random to ``BLOCKS`` x 8 dimensions in each of
``TABLES`` tables; each block of 8 is decoded to its nearest point of the E8
lattice, and the points together name a cell.  Besides its own cell a vector
takes the ``PROBES`` nearest ones, each by a step of one of the 240 shortest
lattice vectors.  Vectors that share a cell in any table are compared by cosine
in double precision.

Equal vectors are one class, compared once and counted with their number.  A
cell only one class has costs nothing further.  A cell of more than ``BLOCK``
classes is cut into blocks and compared block by block in tasks of their own.
A pair of classes is counted in the smallest cell they share, so no pairs
leave a task: it returns, for each class, its number of links and the smallest
class reached there.  ``BLOCKS`` may grow with the logarithm of the table: it
divides the chance neighbours in a cell.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite component
links with nothing, as does a row without an id; vectors of different lengths
never link; repeated rows count as vectors of their own; an empty table gives no
rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import written
from .text import U64, mix

COSINE, TABLES, BLOCKS, WIDTH, PROBES, SEED = 0.95, 5, 2, 1.3, 8, 5
BLOCK, BUCKET_ROWS = 1024, 10_000


def _shortest() -> np.ndarray:
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


STEPS = _shortest()


def _d8(y: np.ndarray) -> np.ndarray:
    """Nearest point of D8 (integers of even sum): round, and if the sum is odd round the worst coordinate the other way."""
    f = np.rint(y)
    off = y - f
    odd = np.flatnonzero(f.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    f[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return f


def e8(y: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the better of D8 and D8 shifted by a half."""
    a, b = _d8(y), _d8(y - 0.5) + 0.5
    nearer = ((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def cell_keys(unit: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, width: float = WIDTH, probes: int = PROBES,
              seed: int = SEED) -> np.ndarray:
    """(vectors x tables * (1 + probes)) 64-bit names of the cells."""
    n, dim = unit.shape
    out = []
    for t in range(tables):
        rng = np.random.default_rng([seed, dim, t])
        points, gains = [], []
        for _ in range(blocks):
            y = unit @ (rng.normal(size=(dim, 8)) / width) + rng.uniform(0, 2, 8)
            p = e8(y)
            points.append(p)
            gains.append((y - p) @ STEPS.T)          # a step's cell is the nearer, the larger this is
        coef = mix(np.arange(1, blocks * 8 + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(t)) | U64(1)
        as_int = lambda x: np.rint(2 * x).astype(np.int64).astype(U64)
        home = (as_int(np.concatenate(points, axis=1)) * coef).sum(axis=1, dtype=U64)
        salt = mix(np.array([dim * 1000 + t], U64))
        out.append(mix(home + salt)[:, None])
        if probes:
            best = np.argpartition(-np.concatenate(gains, axis=1), probes - 1, axis=1)[:, :probes]
            step = np.concatenate([(as_int(STEPS) * coef[8 * b: 8 * b + 8]).sum(axis=1, dtype=U64) for b in range(blocks)])
            out.append(mix(home[:, None] + step[best] + salt))
    return np.concatenate(out, axis=1).view(np.int64)


def _valid(col: pa.Array) -> list[np.ndarray | None]:
    out = []
    for v in col:
        x = v.values
        if x is None or len(x) == 0 or x.null_count:
            out.append(None)
            continue
        x = np.asarray(x.to_numpy(zero_copy_only=False), np.float64) + 0.0
        out.append(x if np.isfinite(x).all() and x.any() else None)
    return out


def _classes(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, fp, vec): the vector as bytes of doubles and its fingerprint, null where it cannot link."""
    def part(batches):
        for batch in batches:
            vs = _valid(batch.column("__vec"))
            ids = batch.column("__id").to_pylist()
            raw = [None if v is None or i is None else v.tobytes() for v, i in zip(vs, ids)]
            fp = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(fp, pa.binary()), pa.array(raw, pa.binary())],
                                             names=["vec_id", "fp", "vec"])

    src = df.select(F.col(vec_id).cast("long").alias("__id"), F.col(vector).cast("array<double>").alias("__vec"))
    return src.mapInArrow(part, "vec_id long, fp binary, vec binary")


def _unit(raws: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(r) for r in raws])
    x = x / np.abs(x).max(axis=1, keepdims=True)        # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(reps: DataFrame, **kw) -> DataFrame:
    def part(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                rows = batch.slice(i, 2000)
                raws, ids = rows.column("vec").to_pylist(), np.array(rows.column("rep").to_pylist(), np.int64)
                sizes = np.array([len(r) for r in raws])
                for size in np.unique(sizes):
                    at = np.flatnonzero(sizes == size)
                    k = cell_keys(_unit([raws[j] for j in at]), **kw)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at], k.shape[1])), pa.array(k.ravel())], names=["rep", "cell"])
    return reps.select("rep", "vec").mapInArrow(part, "rep long, cell long").distinct()


def _local_roots(link: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each row of a symmetric boolean matrix."""
    lab = np.arange(len(link))
    while True:
        new = np.minimum(lab, np.where(link, lab[None, :], len(link)).min(axis=1, initial=len(link)))
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _compare(table: pa.Table, cosine: float) -> pa.Table:
    """All cells of one bucket: links of each class and the smallest class reached."""
    cell, lo, hi, own = (table.column(c).to_numpy() for c in ("cell", "lo", "hi", "own"))
    ids, mult = table.column("rep").to_numpy(), table.column("mult").to_numpy()
    raws = table.column("vec").to_pylist()
    cells = table.column("cells").combine_chunks()
    flat, cut = cells.values.to_numpy(), cells.offsets.to_numpy()
    order = np.lexsort((ids, hi, lo, cell))
    same = (cell[order][1:] == cell[order][:-1]) & (lo[order][1:] == lo[order][:-1]) & (hi[order][1:] == hi[order][:-1])
    edges = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
    out_id, out_root, out_n = [], [], []
    for s, e in zip(edges[:-1], edges[1:]):
        rows = order[s:e]
        if e - s < 2:
            continue
        here, cross = cell[rows[0]], lo[rows[0]] != hi[rows[0]]
        x = _unit([raws[r] for r in rows])
        link = x @ x.T >= cosine
        np.fill_diagonal(link, False)
        if cross:
            link &= own[rows][:, None] != own[rows][None, :]
        if not link.any():
            continue
        # a pair that also shares a smaller cell is counted there
        lists = [flat[cut[r]: cut[r + 1]] for r in rows]
        ks = np.concatenate(lists)
        who = np.repeat(np.arange(len(rows)), [len(k) for k in lists])
        small = ks < here
        ks, who = ks[small], who[small]
        o = np.argsort(ks, kind="stable")
        ks, who = ks[o], who[o]
        count = link.copy()
        runs = np.flatnonzero(np.concatenate([[True], ks[1:] != ks[:-1], [True]])) if len(ks) else np.empty(0, int)
        for p, q in zip(runs[:-1], runs[1:]):
            if q - p > 1:
                m = who[p:q]
                count[np.ix_(m, m)] = False
        roots = _local_roots(link)
        n = count @ mult[rows]
        for k in np.flatnonzero(link.any(axis=1)):
            out_id.append(ids[rows[k]])
            out_root.append(ids[rows[roots[k]]])
            out_n.append(n[k])
    return pa.table({"rep": pa.array(out_id, pa.int64()), "root": pa.array(out_root, pa.int64()), "n": pa.array(out_n, pa.int64())})


def near_duplicates(df: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK,
                    **lattice) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    rows = written(_classes(df, vec_id, vector), "vectors")
    reps = (rows.filter(F.col("fp").isNotNull()).groupBy("fp")
            .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("vec").alias("vec")))
    # equal ids may carry different vectors: the class's name is its own, not the id
    reps = written(reps.withColumn("first_id", F.col("rep")).withColumn("rep", F.xxhash64("fp")), "classes")
    keys = written(_keys(reps, **lattice), "cells")
    many = keys.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = keys.join(many, "cell")
    mine = shared.groupBy("rep").agg(F.collect_list(F.struct("cell", "size")).alias("at"))       # at most one entry a key
    wide = (reps.select("rep", "vec", "mult").join(mine, "rep").withColumn("cells", F.col("at.cell"))
            .select("rep", "vec", "mult", "cells", F.explode("at").alias("x")).select("rep", "vec", "mult", "cells", "x.cell", "x.size"))
    nb = F.ceil(F.col("size") / F.lit(block)).cast("int")
    wide = wide.withColumn("own", F.pmod(F.col("rep"), nb.cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), nb - 1)))
    wide = wide.select("rep", "vec", "mult", "cells", "cell", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    n = many.select(F.sum(F.col("size") * F.ceil(F.col("size") / F.lit(block)))).first()[0] or 0
    buckets = max(1, math.ceil(n / BUCKET_ROWS))
    wide = wide.withColumn("bucket", F.pmod(F.xxhash64("cell", "lo", "hi"), F.lit(buckets)))
    found = written(wide.groupBy("bucket").applyInArrow(lambda t: _compare(t, cosine), "rep long, root long, n long"), "links")
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).filter("a <> b"))
    named = reps.select("rep", "fp", "mult", "first_id").join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.withColumn("comp", F.coalesce("comp", "rep"))
    first = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    per = named.join(first, "comp").select("fp", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    return (rows.select("vec_id", "fp").join(per, "fp", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
