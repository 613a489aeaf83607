"""Batch top-k over a tile join: query blocks x corpus blocks, all on executors.

Rows and queries that may meet share a cell (the vectors' dimension, or a cluster).  The rows of
one cell are dealt by hash into query blocks and corpus blocks of about
``block_bytes`` of vectors.  A query row is sent once to every corpus block and a
corpus row once to every query block of its cell, both under the pair's
number; the two sides meet in an equi-join on that pair (a cogroup), and
one task scores one tile with a matrix product.  A tile gives each of its queries at
most k candidates, which are merged in two levels: first among groups of
about sqrt(corpus blocks) tiles, then per query.

What travels: queries x corpus blocks + corpus rows x query blocks.  A tile's
work grows with the product of its blocks' rows, what it reads with their sum, so with
16 MB blocks the arithmetic outweighs the shuffle.  No row and no count reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BYTES = 16 * 1024 * 1024
# queries and rows of one scored block, kept in memory at a time; rows of a query set's first block
QUERIES, ROWS, FIRST_ROWS = 256, 2_048, 128
KEPT = 1 << 20                                # best rows kept of the queries taken at a time


def topk_mask(score: np.ndarray, kk: int) -> np.ndarray:
    """Boolean mask of the best ``kk`` rows of every column of ``score``
    (rows x queries), ties at the cut going to the lower rows.  With rows in
    ascending id order, that is the (score desc, id asc) order of the final
    ranking, so each batch emits exactly ``kk`` candidates per query even
    when many rows tie (a zero query vector ties with every row)."""
    n = score.shape[0]
    if kk >= n:
        return np.ones_like(score, dtype=bool)
    kth = -np.partition(-score, kk - 1, axis=0)[kk - 1]
    gt = score > kth[None, :]
    eq = score == kth[None, :]
    need = kk - gt.sum(axis=0)
    return gt | (eq & (np.cumsum(eq, axis=0) <= need[None, :]))


def unit_rows(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt(np.einsum("ij,ij->i", m, m))
    zero = norms == 0
    return m / np.where(zero, 1.0, norms)[:, None], zero


class Cosine:
    """Cosines of all queries and rows, a block at a time; 0 where either vector is zero."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray):
        self.r, self.r0 = np.empty(rows.shape), np.empty(len(rows), dtype=bool)
        for s in range(0, len(rows), ROWS):                  # floats become doubles a block at a time
            self.r[s:s + ROWS], self.r0[s:s + ROWS] = unit_rows(rows[s:s + ROWS].astype(np.float64))
        self.ask(queries)

    def ask(self, queries: np.ndarray) -> None:
        """From now on these are the queries."""
        self.q, self.q0 = unit_rows(queries.astype(np.float64))

    def raw(self, q, r: slice) -> np.ndarray:
        """Queries x rows, in the order of the scores."""
        out = self.q[q] @ self.r[r].T
        out[self.q0[q], :] = 0.0
        if self.r0[r].any():
            out[:, self.r0[r]] = 0.0
        return out

    def score(self, raw: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The scores themselves; ``of``: their queries."""
        return raw

    def bound(self, score: np.ndarray, of) -> np.ndarray:
        """For each query a raw value that whatever scores above ``score`` is above."""
        return score


class L2:
    """Negative distances; raw: twice the dot product less the row's square, so only the few in question take a root."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray):
        self.r = rows.astype(np.float64)
        self.rr = np.einsum("ij,ij->i", self.r, self.r)
        self.ask(queries)

    def ask(self, queries: np.ndarray) -> None:
        queries = queries.astype(np.float64)
        self.q, self.qq = 2.0 * queries, np.einsum("ij,ij->i", queries, queries)

    def raw(self, q, r: slice) -> np.ndarray:
        out = self.q[q] @ self.r[r].T
        out -= self.rr[r]
        return out

    def score(self, raw: np.ndarray, of: np.ndarray) -> np.ndarray:
        return -np.sqrt(np.maximum(self.qq[of] - raw, 0.0))

    def bound(self, score: np.ndarray, of) -> np.ndarray:
        far = score * score
        return self.qq[of] - far - 1e-14 * (self.qq[of] + far) - 1e-300      # lower by more than the sums and the root can round


METRICS = {"cosine": Cosine, "l2": L2}


class Parts:
    """Rows that stand part by part (``starts``: the parts' bounds), each part for the queries that ask for it alone.

    ``place``: a row's number in the order of ties, ascending within a part; ``number``: the
    parts' bits in ``bits``, a row of bytes for each query."""

    def __init__(self, at: np.ndarray, bits: np.ndarray):
        """``at``: the part of each row, in the order of ties."""
        self.place = np.argsort(at, kind="stable")
        self.number, first = np.unique(at[self.place], return_index=True)
        self.starts, self.bits = [*first.tolist(), len(at)], bits

    def asked(self, q: slice) -> np.ndarray:
        """Queries x parts."""
        return np.unpackbits(self.bits[q], axis=1)[:, self.number].astype(bool)

    def step(self, k: int) -> int:
        """Queries taken at a time, so that about ``QUERIES`` of them ask for a part."""
        share = self.asked(slice(0, 16 * QUERIES)).mean() if len(self.number) else 1.0
        return max(QUERIES, min(16 * QUERIES, int(QUERIES / max(share, 1e-9)), KEPT // max(k, 1)))


def best(queries: np.ndarray, rows: np.ndarray, ks: np.ndarray, metric: str, parts: Parts | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the best ``ks`` rows of every query, ties going to the lower rows.

    Blocks of rows are scored in ascending order; beyond the first, only what is above the query's
    ``ks``-th best score so far is looked at: a later row of the same score is no better.
    With ``parts`` a query meets the rows of the parts it asks for, and a row's place stands for the row."""
    m = METRICS[metric](queries[:0], rows)
    kk = min(int(ks.max(initial=0)), len(rows))
    starts, place, step = ([0, len(rows)], np.arange(len(rows)), QUERIES) if parts is None else (parts.starts, parts.place, parts.step(kk))
    out = []
    for lo in range(0, len(queries), step):
        q = slice(lo, min(lo + step, len(queries)))
        m.ask(queries[q])
        k, asked = ks[q], None if parts is None else parts.asked(q)
        least = np.full(len(k), -np.inf)
        top, held = np.full((len(k), kk), -np.inf), np.full((len(k), kk), len(rows))       # scores and places
        for j, end in enumerate(starts[1:]):
            asks = np.arange(len(k)) if asked is None else np.flatnonzero(asked[:, j])
            for of in (asks[s:s + QUERIES] for s in range(0, len(asks), QUERIES)):
                at, size = starts[j], ROWS if j else FIRST_ROWS
                while at < end:
                    r = slice(at, min(at + size, end))
                    raw, n = m.raw(of, r), r.stop - at
                    low = np.nextafter(least[of], -np.inf) if j else least[of]        # an equal row of an earlier part may be the later one
                    hit = raw > m.bound(low, of)[:, None]
                    if 8 * np.count_nonzero(hit) > hit.size:                 # the first block, or rows ever nearer
                        score = m.score(raw, of[:, None])
                        hit = topk_mask(score.T, int(k[of].max())).T & (score > low[:, None])
                    w, i = np.divmod(np.flatnonzero(hit), n)
                    s = m.score(raw[w, i], of[w])
                    above = s > low[w]
                    w, i, s = w[above], i[above], s[above]
                    if len(w):
                        who, w = np.unique(of[w], return_inverse=True)
                        w = np.concatenate([np.repeat(np.arange(len(who)), kk), w])
                        row, s = np.concatenate([held[who].ravel(), place[at + i]]), np.concatenate([top[who].ravel(), s])
                        order = np.lexsort((row, -s, w))
                        first = np.searchsorted(w[order], np.arange(len(who)))
                        keep = order[np.arange(len(order)) - first[w[order]] < kk]
                        top[who], held[who] = s[keep].reshape(-1, kk), row[keep].reshape(-1, kk)
                        least[who] = top[who, np.minimum(k[who], kk) - 1]
                    at, size = r.stop, min(2 * size, ROWS)
        w, rank = np.nonzero((top > -np.inf) & (np.arange(kk) < k[:, None]))
        out.append((lo + w, held[w, rank], top[w, rank]))
    return tuple(np.concatenate([np.empty(0, t), *x]) for x, t in zip(zip(*out), (np.int64, np.int64, float)))


def vectors(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors in the type they came in."""
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in col.chunks]
    return (np.concatenate(flat) if flat else np.empty(0)).reshape(-1, dim)


def matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    return vectors(col, dim).astype(np.float64)


Q_COLS = ["qid", "_q", "_k", "_copies"]
_TILE = "qid long, _q long, _k int, _copies long, id long, _row long, similarity double, _cell long, _g long"


def _tile(metric: str):
    """applyInArrow body: the candidates of one tile."""
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    schema = pa.schema([(n, types[t]) for n, t in (x.split() for x in _TILE.split(", "))])

    def score(queries: pa.Table, corpus: pa.Table) -> pa.Table:
        if not queries.num_rows or not corpus.num_rows:
            return schema.empty_table()
        ids = corpus.column("id").to_numpy()
        own = corpus.column("_row").to_numpy()
        asking = vectors(queries.column("_v"), len(queries.column("_v")[0]))
        rows = vectors(corpus.column("_v"), asking.shape[1])
        order = np.lexsort((own, ids))                      # in id order, so ties at the cut keep the lowest ids
        order = order[np.isfinite(rows).all(axis=1)[order]]  # a null component reads as NaN
        ids, own, parts = ids[order], own[order], None
        if "_in" in queries.column_names:
            bits = pc.cast(queries.column("_in"), pa.binary()).to_numpy()
            parts = Parts(corpus.column("_at").to_numpy()[order], np.frombuffer(b"".join(bits), dtype=np.uint8).reshape(len(bits), -1))
            order = order[parts.place]
        rows = rows[order]
        at, row, sim = best(asking, rows, queries.column("_k").to_numpy(), metric, parts)
        n = len(at)
        mine = queries.select(Q_COLS).take(pa.array(at))
        return pa.table([*mine.columns, pa.array(ids[row]), pa.array(own[row]), pa.array(sim),
                         pa.array(np.full(n, corpus.column("_cell")[0].as_py())), pa.array(np.full(n, corpus.column("_g")[0].as_py()))], schema=schema)

    return score


def _ranked(cand: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy("qid", "_q", *by).orderBy(F.col("similarity").desc(), F.col("id").asc(), F.col("_row").asc())
    return cand.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= F.col("_k"))


def every(n: str):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


def tile_topk(corpus: DataFrame, queries: DataFrame, metric: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(qid, _copies, rank, id, _row, similarity): the best ``_k`` corpus rows of every query.

    ``corpus``: id, _row (a number that tells rows of one id apart), _v, _cell;
    ``queries``: qid, _q (a number that tells queries of one qid apart), _k, _copies (passed on), _v, _cell; a query
    may stand in several cells, a corpus row in one.  The vectors of a cell are of one
    dimension; non-finite corpus vectors take no part."""
    def sizes(df, name):
        return df.groupBy("_cell").agg(F.count(F.lit(1)).alias(name), F.max(F.size("_v")).alias("_d"))

    def blocks(n, d):
        return F.greatest(F.lit(1), F.ceil(F.col(n) * F.col(d) * 8 / F.lit(block_bytes))).cast("long")

    cores = queries.sparkSession.sparkContext.defaultParallelism
    cells = sizes(queries, "_nq").join(sizes(corpus, "_nc").drop("_d"), "_cell")
    # a row per dimension: few whatever the rows; of a small set, a tile of some rows for every core
    return tiled(corpus, queries, metric, cells.select("_cell", blocks("_nq", "_d").alias("_qbs"), F.greatest(
        blocks("_nc", "_d"), F.least(F.lit(cores), F.ceil(F.col("_nc") / 1_000)).cast("long")).alias("_cbs")))


def tiled(corpus: DataFrame, queries: DataFrame, metric: str, cells: DataFrame, one_block: bool = False) -> DataFrame:
    """``tile_topk`` over the given ``cells``: _cell, _qbs and _cbs, its blocks of queries and of rows; ``one_block``: all ``_cbs`` are 1.

    With ``_in`` in the queries and ``_at`` in the corpus, a query meets those rows of its cell
    alone whose part ``_at`` is among its parts: ``_in``, a bit each, as many bytes for every query of a cell."""
    cells = F.broadcast(cells)
    block = lambda c, n: F.pmod(F.xxhash64(F.col(c), F.col(n)), F.col(n))
    groups = F.ceil(F.sqrt("_cbs")).cast("long")
    parts = [x for x in ("_in", "_at") if x in queries.columns + corpus.columns]
    q = queries.join(cells, "_cell").select(*Q_COLS, "_v", *parts[:1], "_cell", block("_q", "_qbs").alias("_qb"), every("_cbs").alias("_cb"))
    c = corpus.join(cells, "_cell").select("id", "_row", "_v", *parts[1:], "_cell", "_qbs", block("_row", "_cbs").alias("_cb"), groups.alias("_gs"))
    c = c.select("id", "_row", "_v", *parts[1:], "_cell", "_cb", F.pmod("_cb", "_gs").alias("_g"), every("_qbs").alias("_qb"))
    key = ["_cell", "_qb", "_cb"]
    cand = q.groupBy(*key).cogroup(c.groupBy(*key)).applyInArrow(_tile(metric), _TILE)
    return _ranked(cand if one_block else _ranked(cand, ["_cell", "_g"]), []).select("qid", "_copies", "rank", "id", "_row", "similarity")
