"""Jaccard join of documents on word shingles, by vertical partitioning.

A document's set is its distinct ``WIDTH``-word shingles (64-bit hashes).  All
shingles stand in one global order, rare before common, and that order is cut
into fragments.

1. One scan gives each document's set size and fingerprint, and a sketch of
   2^``SKETCH_BITS`` counters of how often shingles occur: a shingle's place in the
   order is its counter's size class, then its hash.  Documents with equal sets
   are one node from here on.
2. A second scan sends each set's prefix (the rarest shingles, as many as two
   similar sets cannot both miss) to the fragments of the order, a node once a task.  In
   a fragment, a shingle's nodes form a list.
3. Candidate pairs are verified fragment by fragment: a pair's partial overlaps
   are counted in each fragment of the order and summed per pair; the first
   fragments' sums rule most pairs out before the other fragments are read.
4. Not all pairs of a list are formed: lists are first linked to one pivot each,
   verified, and merged into components; then every pair that a list still holds
   between different components is formed, so no link between components is lost.

Hot shingles (by the sketch) are salted over several fragments' tasks.  The
sketch and the node filter are tables of fixed size; only they reach
the driver.

Defined cases: a null or blank text has an empty set, size 0, and links with
nothing; a text of 1 to ``WIDTH`` - 1 words has one shingle, the whole; repeated rows
and equal ids are rows of their own, linked if their sets are; a null id joins
its component but never names it unless it has no other; an empty table gives no
rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import written
from .text import LOWER, U64, groups, mix, string_buffers, windows, word_hashes

WIDTH, PERCENT = 5, 75
SKETCH_BITS, CHUNK_BITS = 22, 14                 # 2^22 counters, sent in 2^8 chunks
FILTER_BITS = 26                                 # 8 MB: which documents' sets the verification reads
FRAGMENT = 250_000                               # prefix entries to a fragment
FLUSH = 300_000                                  # prefix entries a task holds before it sends them
SEGMENTS, EARLY = 4, 1                           # fragments of the order in the verification; those counted first
KEY_BYTES = 6                                    # of a shingle's hash, compared inside a fragment of a pair
PAIR_ROWS = 1_000                                # pairs with one pivot to a task's group


def sets(col: pa.Array, width: int = WIDTH):
    """Sorted distinct shingle hashes of each text, one after another."""
    buf, offs = string_buffers(col)
    for i, j in groups(offs):
        b = LOWER[buf[offs[i]: offs[j]]]
        h, at = word_hashes(b, offs[i: j + 1] - offs[i])
        for k in range(j - i):
            w = h[at[k]: at[k + 1]]
            yield np.unique(windows(w, min(width, len(w)))) if len(w) else np.empty(0, U64)


def fingerprint(s: np.ndarray) -> int:
    """64-bit hash of a set (and its size)."""
    x = mix(s + U64(0x9E3779B97F4A7C15))
    h = np.array([x.sum(dtype=U64), np.bitwise_xor.reduce(mix(x)), U64(len(s))])
    return int(mix((mix(h) * np.array([3, 5, 7], U64)).sum(keepdims=True, dtype=U64)).view(np.int64)[0])


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def needed(na, nb, percent: int = PERCENT):
    """Smallest overlap of two similar sets: 100 o >= percent (na + nb - o)."""
    return -(-percent * (na + nb) // (100 + percent))


class Order:
    """The global order, from the sketch: rare size classes first, by hash inside a class."""

    def __init__(self, chunks):
        """``chunks``: (number, size classes of its counters, occurrences by class)."""
        self.classes, self.mass = np.zeros(1 << SKETCH_BITS, np.uint8), np.zeros(256)
        for k, c, mass in chunks:
            self.classes[k << CHUNK_BITS: (k + 1) << CHUNK_BITS] = c
            self.mass += mass

    def place(self, s: np.ndarray) -> np.ndarray:
        """Order keys, ascending from rare to common."""
        c = self.classes[(s & U64(len(self.classes) - 1)).astype(np.int64)].astype(U64)
        return (c << U64(56)) | (s >> U64(8))

    def cuts(self, shares: np.ndarray) -> np.ndarray:
        """The keys below which these shares of all occurrences lie."""
        cum = np.concatenate([[0], np.cumsum(self.mass)])
        total = max(cum[-1], 1)
        c = np.clip(np.searchsorted(cum, shares * total, "right") - 1, 0, 255)
        inside = np.clip((shares * total - cum[c]) / np.maximum(self.mass[c], 1), 0, 1 - 2**-50)
        return (c.astype(U64) << U64(56)) | (inside * 2.0**56).astype(U64)


def planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second bytes and so on: what is alike stands together and compresses."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def from_planes(b: bytes, typ) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(np.dtype(typ).itemsize, -1).T.copy().view(typ).ravel()


def short(keys: np.ndarray) -> bytes:
    """The low ``KEY_BYTES`` bytes of order keys: all from the hash."""
    return keys.astype("<u8").view(np.uint8).reshape(len(keys), 8)[:, :KEY_BYTES].tobytes()


def from_short(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(b, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel()


def often(keys: np.ndarray) -> np.ndarray:
    """Upper bound of how often the shingles of these order keys occur."""
    return np.exp2(((keys >> U64(56)).astype(np.float64) + 1) / 4)


def _profile(df: DataFrame, width: int) -> DataFrame:
    """Rows (doc_id, node, n) of every document, and rows (chunk, counts) of each task's sketch."""
    schema = "doc_id long, node long, n long, chunk int, counts binary"

    def part(batches):
        counters = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            nodes, sizes, many = [], [], []
            for s in sets(batch.column("__text"), width):
                nodes.append(fingerprint(s) if len(s) else None)
                sizes.append(len(s))
                many.append(s)
                if len(many) == 512:
                    _count(counters, many)
                    many = []
            _count(counters, many)
            n = len(nodes)
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                                              pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=[x.split()[0] for x in schema.split(", ")])
        size = 1 << CHUNK_BITS
        full = [k for k in range(len(counters) // size) if counters[k * size: (k + 1) * size].any()]
        if full:
            blobs = [zlib.compress(counters[k * size: (k + 1) * size].tobytes(), 1) for k in full]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(full), pa.int64())] * 3 + [pa.array(full, pa.int32()), pa.array(blobs, pa.binary())],
                                             names=[x.split()[0] for x in schema.split(", ")])

    return df.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text")).mapInArrow(part, schema)


def _count(counters: np.ndarray, many: list[np.ndarray]) -> None:
    if many:
        at = (np.concatenate(many) & U64(len(counters) - 1)).astype(np.int64)
        k, n = np.unique(at, return_counts=True)
        counters[k] = np.minimum(counters[k].astype(np.int64) + n, 2**32 - 1).astype(np.uint32)


def _order(rows: DataFrame) -> Order:
    """The tasks' sketches are summed chunk by chunk on the executors; their size classes, a byte a counter, reach the driver."""
    def part(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                c = np.frombuffer(zlib.decompress(blob), np.uint32).astype(np.int64)
                sums[k] = sums.get(k, 0) + c
        for k, n in sums.items():
            c = np.floor(4 * np.log2(np.maximum(n, 1))).astype(np.uint8)
            mass = np.bincount(c, weights=n, minlength=256)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(c.tobytes(), 1)], pa.binary()),
                                              pa.array([mass.tobytes()], pa.binary())], names=["chunk", "classes", "mass"])

    summed = (rows.filter("chunk is not null").select("chunk", "counts").repartition("chunk")
              .mapInArrow(part, "chunk int, classes binary, mass binary"))
    return Order((r["chunk"], np.frombuffer(zlib.decompress(r["classes"]), np.uint8), np.frombuffer(r["mass"])) for r in summed.toLocalIterator())


def _postings(df: DataFrame, order, cuts: np.ndarray, width: int, percent: int) -> DataFrame:
    """Prefix entries packed by fragment and salt: (frag, salt, key, node, n, pos) as byte planes, the keys as differences."""
    names = ["frag", "salt", "key", "node", "n", "pos"]

    def flush(have):
        key, node, n, pos = (np.concatenate(x) for x in zip(*have))
        frag = np.searchsorted(cuts, key, "right").astype(np.int64)
        split = np.maximum(1, np.ceil(often(key) / FRAGMENT)).astype(np.int64)
        salt = (node.view(U64) % split.astype(U64)).astype(np.int64)
        o = np.lexsort((node, key, salt, frag))
        key, node, n, pos, frag, salt = (x[o] for x in (key, node, n, pos, frag, salt))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
        key, node, n, pos, frag, salt = (x[new] for x in (key, node, n, pos, frag, salt))
        at = np.flatnonzero(np.concatenate([[True], (frag[1:] != frag[:-1]) | (salt[1:] != salt[:-1]), [True]]))
        step = np.diff(key, prepend=U64(0))
        step[at[:-1]] = key[at[:-1]]                    # a pack's first key is whole
        cols = [[planes(x[s:e]) for s, e in zip(at[:-1], at[1:])] for x in (step, node, n, pos)]
        return pa.RecordBatch.from_arrays([pa.array(frag[at[:-1]].astype(np.int32)), pa.array(salt[at[:-1]].astype(np.int32)),
                                           *(pa.array(c, pa.binary()) for c in cols)], names=names)

    def part(batches):
        have, size = [], 0
        for batch in batches:
            for s in sets(batch.column("__text"), width):
                if not len(s):
                    continue
                k = np.sort(order.value.place(s))[: prefix_length(len(s), percent)]
                have.append((k, np.full(len(k), fingerprint(s), np.int64), np.full(len(k), len(s), np.int32), np.arange(len(k), dtype=np.int32)))
                size += len(k)
                if size >= FLUSH:
                    yield flush(have)
                    have, size = [], 0
        if have:
            yield flush(have)

    return (df.select(F.col("text").alias("__text"))
            .mapInArrow(part, "frag int, salt int, key binary, node binary, n binary, pos binary"))


def _lists(table: pa.Table, percent: int, hot: int) -> pa.Table:
    """One fragment: the entries of every shingle that can be the rarest one some similar pair shares.

    If two similar sets first meet at places i and j, they differ in at least
    i + j shingles, so 25 n - 175 i (at 75 %) of both, their scores, sum to 0
    or more.  An entry stays if that holds with the best other entry of its list
    and if the sizes leave it a partner; a salted shingle keeps all its entries.  A list's pivot is its best entry:
    of a family of copies the least edited one."""
    node, n, pos = (np.concatenate([from_planes(b, t) for b in table.column(c).to_pylist()]) for c, t in
                    (("node", np.int64), ("n", np.int32), ("pos", np.int32)))
    key = np.concatenate([np.cumsum(from_planes(b, U64), dtype=U64) for b in table.column("key").to_pylist()])
    score = (100 - percent) * n.astype(np.int64) - (100 + percent) * pos.astype(np.int64)
    o = np.lexsort((node, -score, key))                 # a node's entries of a key are equal, so they are neighbours
    key, node, n, score = (c[o] for c in (key, node, n, score))
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
    key, node, n, score = (c[new] for c in (key, node, n, score))
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    first = starts[np.repeat(np.arange(len(starts)), sizes)]
    best = score[first]
    best[starts] = np.where(sizes > 1, score[np.minimum(starts + 1, len(key) - 1)], np.iinfo(np.int32).min)
    which = np.repeat(np.arange(len(starts)), sizes)
    keep = (score + best >= 0) & _partnered(which, first, n.astype(np.int64), score, percent) | (often(key) > hot)
    return pa.table({"key": pa.array(key[keep].view(np.int64)), "node": pa.array(node[keep]), "n": pa.array(n[keep].astype(np.int64)),
                     "score": pa.array(score[keep]), "pnode": pa.array(node[first][keep]),
                     "pn": pa.array(n[first][keep].astype(np.int64)), "pscore": pa.array(score[first][keep])})


def _partnered(which: np.ndarray, first: np.ndarray, n: np.ndarray, score: np.ndarray, percent: int) -> np.ndarray:
    """Entries whose list (``which``, beginning at ``first``) may hold another one that ``_possible`` allows:
    percent * nb <= percent * na + sa, and the same the other way round.  It never leaves out one that has such a partner."""
    size, reach = percent * n, percent * n + score
    base = which * (int(max(size.max(), reach.max())) + 1)
    o = np.argsort(base + size, kind="stable")
    size, reach, base, begin = size[o], reach[o], base[o], first[o]
    at = np.arange(len(o))
    end = np.searchsorted(base + size, base + reach, "right")           # entries before it are small enough for this one
    upto = np.minimum(end, at)
    top = np.maximum.accumulate(base + reach)[np.maximum(upto, 1) - 1] - base
    out = np.empty(len(o), bool)
    out[o] = (upto > begin) & (top >= size) | (end > at + 1)
    return out


LIST_SCHEMA = "key long, node long, n long, score long, pnode long, pn long, pscore long"


def _possible(na: str, sa: str, nb: str, sb: str, percent: int):
    """At their first shared shingle, both sets still hold as many as similar sets of these sizes share:
    (100 + percent) (na - i) >= percent (na + nb), written with the scores, and the same for b."""
    more = percent * (F.col(nb) - F.col(na))
    return (F.col(sa) >= more) & (F.col(sb) >= -more)


def _node_filter(ids: DataFrame) -> np.ndarray:
    """A bit table of fixed size of the document ids given; it reaches the driver whole, in chunks made on the executors."""
    bits, chunk = 1 << FILTER_BITS, 1 << 18

    def part(batches):
        got: dict[int, np.ndarray] = {}
        for batch in batches:
            at = _bit(batch.column("doc_id").to_numpy())
            for k in np.unique(at // chunk):
                got.setdefault(int(k), np.zeros(chunk, bool))[at[at // chunk == k] % chunk] = True
        for k, b in got.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(b).tobytes()], pa.binary())], names=["k", "bits"])

    def merge(batches):
        got: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(batch.column("k").to_pylist(), batch.column("bits").to_pylist()):
                got[k] = got.get(k, np.uint8(0)) | np.frombuffer(b, np.uint8)
        for k, b in got.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([b.tobytes()], pa.binary())], names=["k", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    schema = "k int, bits binary"
    for r in ids.mapInArrow(part, schema).repartition("k").mapInArrow(merge, schema).toLocalIterator():
        out[r["k"] * chunk // 8: (r["k"] + 1) * chunk // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _has(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _bit(ids)
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _bit(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U64)) >> U64(64 - FILTER_BITS)).astype(np.int64)


class Join:
    """The state of one join: the documents, their nodes and the order."""

    def __init__(self, df: DataFrame, doc_id: str, text: str, width: int, percent: int):
        self.spark, self.width, self.percent = df.sparkSession, width, percent
        self.docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        rows = written(_profile(self.docs, width), "profile")
        self.rows = rows.filter("chunk is null").select("doc_id", "node", "n")
        self.nodes = (self.rows.filter("node is not null").groupBy("node")
                      .agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n")))
        order = _order(rows)
        self.order = self.spark.sparkContext.broadcast(order)        # a byte a counter, whatever the input
        entries = order.mass.sum() * (100 - percent) / 100
        parts = max(1, math.ceil(entries / FRAGMENT))
        tail = max(1, parts // 4)
        low = (100 - percent) / 100 * 1.1
        self.cuts = order.cuts(np.concatenate([np.arange(1, parts) / parts * low, low + np.arange(tail) / tail * (1 - low)]))
        self.segments = order.cuts(np.arange(1, SEGMENTS) / SEGMENTS)

    def lists(self) -> DataFrame:
        posted = _postings(self.docs, self.order, self.cuts, self.width, self.percent)
        percent, hot = self.percent, FRAGMENT
        return written(posted.groupBy("frag", "salt").applyInArrow(lambda t: _lists(t, percent, hot), LIST_SCHEMA), "lists")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b; b is the pivot) that are similar.

        A set is cut at the segments of the global order; each segment of a
        pivot meets the same segment of its pairs' other nodes in one group, where the partial
        overlaps are counted, and the sums per pair decide."""
        order, cuts, width, percent = self.order, self.segments, self.width, self.percent
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = wanted.join(self.nodes, "node").select(F.col("first_id").alias("doc_id"))
        keep = self.spark.sparkContext.broadcast(_node_filter(wanted.filter("doc_id is not null")))

        def part(batches):
            for batch in batches:
                ids = pc.fill_null(batch.column("__id"), 0).to_numpy()
                hit = _has(keep.value, ids) | batch.column("__id").is_null().to_numpy(zero_copy_only=False)
                for i in range(0, len(ids), 500):
                    mine = np.flatnonzero(hit[i: i + 500]) + i
                    if not len(mine):
                        continue
                    nodes, segs, sizes = [], [], []
                    for s in sets(batch.column("__text").take(pa.array(mine)), width):
                        if len(s):
                            k = np.sort(order.value.place(s))
                            at = np.searchsorted(k, cuts)
                            nodes.append(fingerprint(s))
                            segs.append([short(x) for x in np.split(k, at)])
                            sizes.append(len(s))
                        else:
                            nodes.append(None)
                            segs.append(None)
                            sizes.append(0)
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(segs, pa.list_(pa.binary()))],
                                                     names=["node", "n", "segs"])

        found = (self.docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
                 .mapInArrow(part, "node long, n long, segs array<binary>").filter("node is not null"))
        # chance hits and equal rows add a few more; the join by node and the counting leave them out
        have = written(found, "segments")
        keep.destroy()
        # the first fragments bound a pair's overlap; the others are read for the pairs still possible
        most = F.col("o") + F.least(F.col("na") - F.col("la"), F.col("nb") - F.col("lb"))
        first = self._counted(pairs, have, 0, EARLY).filter(100 * most >= percent * (F.col("na") + F.col("nb") - most))
        first = written(first.select("a", "b", "size", "o"), "possible")
        rest = self._counted(first.select("a", "b", "size"), have, EARLY, SEGMENTS).withColumnRenamed("o", "more")
        o = F.col("o") + F.col("more")
        return first.select("a", "b", "o").join(rest, ["a", "b"]).filter(100 * o >= percent * (F.col("na") + F.col("nb") - o)).select("a", "b")

    def _counted(self, pairs: DataFrame, have: DataFrame, lo: int, hi: int) -> DataFrame:
        """(a, b, size, na, nb, o, la, lb): the sets' sizes, and overlap and lengths of each pair in the fragments lo .. hi - 1.
        ``size`` is a bound of the pairs of a pivot."""
        have = have.select("node", "n", F.slice("segs", lo + 1, hi - lo).alias("segs"))
        salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.ceil(F.col("size") / F.lit(PAIR_ROWS))).cast("int"))
        left = salted.select("a", F.col("b").alias("pivot"), "salt", "size", F.col("a").alias("node"))
        right = salted.select("b", "salt", "size").distinct().select(F.lit(None).cast("long").alias("a"), F.col("b").alias("pivot"), "salt", "size", F.col("b").alias("node"))
        cut = (left.unionByName(right).join(have, "node")
               .select("pivot", "salt", "size", "a", "n", F.posexplode("segs").alias("seg", "keys"))
               .withColumn("task", F.pmod(F.xxhash64("pivot", "salt", "seg"), F.lit(self._tasks(pairs)))))

        def count(t: pa.Table) -> pa.Table:
            piv, salt, seg, n, size = (t.column(c).to_numpy() for c in ("pivot", "salt", "seg", "n", "size"))
            a, keys = t.column("a").to_pylist(), t.column("keys").to_pylist()
            whole = {(piv[k], salt[k], seg[k]): (np.sort(from_short(keys[k])), n[k]) for k, x in enumerate(a) if x is None}
            out: dict = {}
            for k, x in enumerate(a):
                if x is not None:
                    (base, nb), mine, same = whole[piv[k], salt[k], seg[k]], from_short(keys[k]), 0
                    if len(base) and len(mine):
                        at = np.minimum(np.searchsorted(base, mine), len(base) - 1)
                        same = int((base[at] == mine).sum())
                    out[x, piv[k], seg[k]] = (x, piv[k], size[k], n[k], nb, same, len(mine), len(base))
            names = ["a", "b", "size", "na", "nb", "o", "la", "lb"]
            return pa.table([pa.array(c, pa.int64()) for c in zip(*out.values())] or [pa.array([], pa.int64())] * len(names), names=names)

        part_sums = cut.groupBy("task").applyInArrow(count, "a long, b long, size long, na long, nb long, o long, la long, lb long")
        return part_sums.groupBy("a", "b").agg(*(F.max(c).alias(c) for c in ("size", "na", "nb")), *(F.sum(c).alias(c) for c in ("o", "la", "lb")))

    def _tasks(self, pairs: DataFrame) -> int:
        return max(1, math.ceil(pairs.count() / 1_000))

    def checked(self, pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """(all pairs tried, the similar ones); ``pairs`` are distinct (a, b)."""
        sized = pairs.join(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("size")), "b").select("a", "b", "size")
        sized = written(sized, name)
        return sized.select("a", "b"), written(self.verified(sized), "similar")

    def run(self) -> DataFrame:
        """(node, comp): the components of the nodes that link with another one."""
        lists = self.lists()
        star = lists.filter((F.col("node") != F.col("pnode")) & _possible("n", "score", "pn", "pscore", self.percent))
        # each node's pivot of most shared prefix shingles
        star = star.groupBy(F.col("node").alias("a"), F.col("pnode").alias("b")).agg(F.count(F.lit(1)).alias("c"))
        star = star.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))
        tried, links = self.checked(star, "pairs")
        comp = components(links)
        named = lists.select("key", "node", "n", "score").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
        left = written(named.join(mixed, "key"), "open")
        x = left.select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("score").alias("sa"), F.col("comp").alias("ca"))
        y = left.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("score").alias("sb"), F.col("comp").alias("cb"))
        new = x.join(y, "key").filter((F.col("ca") < F.col("cb")) & _possible("na", "sa", "nb", "sb", self.percent)).select("a", "b").distinct()
        both = tried.unionByName(tried.select(F.col("a").alias("b"), F.col("b").alias("a")))
        similar = self.checked(new.join(both, ["a", "b"], "left_anti"), "pairs")[1]
        self.order.destroy()                  # everything that reads it is written
        return components(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(similar))


def similar(df: DataFrame, width: int = WIDTH, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, node, n_shingles and component_id of every row; ``node`` names the row's set (null: empty)."""
    j = Join(df, doc_id, text, width, percent)
    comp = j.run()
    named = j.nodes.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    first = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    per = named.join(first, "comp").select("node", "component_id")
    return (j.rows.join(per, "node", "left")
            .select("doc_id", "node", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id"))
                    .otherwise(F.col("component_id")).alias("component_id")))


def keep_one(df: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of a documents frame without near-duplicates: of each component the
    row of its smallest doc_id stays (of equal ones, one), with its columns unchanged."""
    cols = df.columns
    typ = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    found = written(similar(df, width, percent), "components")
    at_text = f"__x{cols.index('text')}"                  # a text is sent to the workers once
    stay = (found.filter(F.col("node").isNotNull()).groupBy("node").agg(F.first("component_id").alias("component_id")))

    def part(batches):
        for batch in batches:
            nodes = [fingerprint(s) if len(s) else None for s in sets(batch.column(at_text), width)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f"__x{k}") for k in range(len(cols))), pa.array(nodes, pa.int64())],
                                             names=[*(f"__x{k}" for k in range(len(cols))), "node"])

    src = df.select(*(F.col(f"`{c}`").alias(f"__x{k}") for k, c in enumerate(cols)))
    rows = src.mapInArrow(part, "".join(f"__x{k} {typ[c]}, " for k, c in enumerate(cols)) + "node long")
    key = f"__x{cols.index('doc_id')}"
    rows = rows.withColumn("alone", F.when(F.col("node").isNull(), F.monotonically_increasing_id()))
    kept = (rows.join(stay, "node", "left").filter(F.col("node").isNull() | F.col(key).eqNullSafe(F.col("component_id")))
            .dropDuplicates([key, "node", "alone"]))
    return kept.select(*(F.col(f"__x{k}").alias(c) for k, c in enumerate(cols)))
