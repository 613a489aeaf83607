"""V1: approximate cosine top-k by cluster pruning (opt-in; exact search is the
default everywhere else).

Index: ``pyspark.ml`` KMeans with cosine distance, trained on a bounded
sample of the corpus (every row is still assigned and searchable).  Search:
clusters are gathered into cells of a block of rows, and the tile join (``operators.tiles``)
brings a cell's rows and the queries together that probe some of its clusters,
a large cluster in several tiles.  A query travels once to each such cell, with a bit for
each of the cell's clusters: whether it is among the query's ``nprobe`` nearest.  No query reaches the driver.
Unless given, the cluster count grows with the corpus and ``nprobe`` is chosen
by ``choose_nprobe``: recall measured against exact search on a query sample.
Report the scanned share beside recall (``scanned_share``).

Stored form: ``write_clustered`` writes the corpus partitioned by cluster
id and ``ann_topk_stored`` reads only the probed clusters' folders
(partition pruning), so I/O shrinks with the probe count, not only work.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ragtide.functions.vector import as_double_array
from ragtide.operators.tiles import Q_COLS, matrix, tiled, topk_mask, unit_rows
from ragtide.operators.topk import answers, distinct_queries, finite_vector, topk_batch

MIN_RECALL, SAMPLE_QUERIES = 0.9, 256
PROBE_ENTRIES = 1_000_000                     # queries x centroids compared at a time
BLOCK_BYTES = 48 * 1024 * 1024                # a cell's vectors as doubles, and a query block's
TILES = 3                                     # tiles a core of a small set
MIN_CLUSTERS, ROWS_PER_CENTROID = 40, 50      # training rows a centroid has at least, beyond MIN_CLUSTERS


class ClusterIndex:
    def __init__(self, model, centroids: np.ndarray):
        self.model = model
        self.centroids, _ = unit_rows(np.asarray(centroids, dtype=np.float64))

    def assign(self, corpus: DataFrame, vec_col: str = "embedding") -> DataFrame:
        """Corpus rows with their cluster id (JVM-side nearest centroid).

        Cosine distance is undefined for a zero vector (and the model
        refuses one), so a zero row is assigned through a stand-in unit
        vector and then placed in cluster 0: it stays searchable, with
        similarity 0 to every query, in one pass over the corpus."""
        dim = self.centroids.shape[1]
        arr = as_double_array(vec_col)
        nonzero = F.exists(arr, lambda x: x != 0)
        unit = F.array(*([F.lit(1.0)] + [F.lit(0.0)] * (dim - 1))).cast("array<double>")
        v = corpus.withColumn("_nz", nonzero) \
            .withColumn("_features", array_to_vector(F.when(F.col("_nz"), arr).otherwise(unit)))
        out = self.model.transform(v)
        return (out.withColumn("cluster", F.when(F.col("_nz"), F.col("_cluster")).otherwise(F.lit(0)))
                .drop("_features", "_cluster", "_nz"))


def build_index(corpus: DataFrame, n_clusters: int | None = None, *, vec_col: str = "embedding",
                seed: int = 1, max_train_rows: int = 200_000, max_iter: int = 20) -> ClusterIndex:
    """Fit cosine KMeans on at most ``max_train_rows`` sampled non-zero vectors.
    Unless given, there are as many clusters as the square root of the rows,
    ``MIN_CLUSTERS`` at least and one for ``ROWS_PER_CENTROID`` training rows at most."""
    nz = corpus.where(F.col(vec_col).isNotNull()).select(as_double_array(vec_col).alias("_v")) \
        .where(finite_vector("_v") & F.exists("_v", lambda x: x != 0))
    n = nz.count()
    if n_clusters is None:
        n_clusters = max(MIN_CLUSTERS, min(math.isqrt(n), max_train_rows // ROWS_PER_CENTROID))
    frac = min(1.0, max_train_rows / max(n, 1))
    train = nz.sample(False, frac, seed) if frac < 1.0 else nz
    train = train.select(array_to_vector("_v").alias("_features"))
    km = KMeans(k=max(1, min(n_clusters, n)), seed=seed, maxIter=max_iter, distanceMeasure="cosine",
                featuresCol="_features", predictionCol="_cluster")
    model = km.fit(train)
    return ClusterIndex(model, np.vstack(model.clusterCenters()))


def _cells(sizes: np.ndarray, block_rows: int, cores: int) -> np.ndarray:
    """For every cluster the first cluster of its cell.  Cells are runs of clusters of about equally many rows together, a
    block at most unless one cluster has more; of a small corpus enough for ``TILES`` tiles a core with as many query blocks."""
    total = int(sizes.sum())
    n = max(1, -(-10 * total // (9 * block_rows)), min(math.isqrt(TILES * cores - 1) + 1, -(-total // 1_000)))
    middle = np.cumsum(sizes) - sizes / 2
    cell = np.minimum((middle * n / max(total, 1)).astype(np.int64), n - 1)
    return np.searchsorted(cell, cell)


def _probed(q: DataFrame, idx: ClusterIndex, nprobe: int, cell: np.ndarray | None = None, kind: str = "array<double>") -> DataFrame:
    """The queries of ``distinct_queries``, each once for every cell (``_cell``) with some of its ``nprobe`` nearest
    clusters; ``_in`` has a bit for each cluster of the cell.  ``cell`` gives every cluster the first cluster of its
    cell, a cluster is a cell of its own otherwise.  A zero query ties with every centroid and probes the first ones."""
    n, dim = idx.centroids.shape
    p, cell = min(nprobe, n), np.arange(n) if cell is None else cell
    bc = q.sparkSession.sparkContext.broadcast(idx.centroids)      # bounded by build_index's max_train_rows

    first = np.unique(cell)
    width = -(-int(np.diff([*first, n]).max()) // 8)               # bytes of a cell's clusters
    bit = np.searchsorted(first, cell) * 8 * width + np.arange(n) - cell
    step = max(1, PROBE_ENTRIES // max(n, len(first) * width))

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, step):
                rows = batch.slice(s, step)
                unit, _ = unit_rows(matrix(pa.chunked_array([rows.column("_v")]), dim))
                near = np.zeros((rows.num_rows, len(first) * 8 * width), dtype=bool)
                near[:, bit] = topk_mask((unit @ bc.value.T).T, p).T
                near = np.packbits(near, axis=1).reshape(rows.num_rows, len(first), width)
                hit = near.any(axis=2)
                near, ends = near[hit], np.r_[0, np.cumsum(hit.sum(axis=1))].astype(np.int32)
                bits = pa.Array.from_buffers(pa.binary(), len(near), [None, pa.py_buffer(np.arange(len(near) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(near.tobytes())])
                cells = pa.StructArray.from_arrays([pa.array(np.broadcast_to(first, hit.shape)[hit].astype(np.int64)), bits], names=["cell", "clusters"])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(ends, cells)], names=[*rows.schema.names, "_cells"])

    # the vector leaves Python once, however many cells it probes
    near = (q.where(F.size("_v") == dim).select(*Q_COLS, F.col("_v").cast(kind).alias("_v"))
            .mapInArrow(run, f"qid long, _q long, _k int, _copies long, _v {kind}, _cells array<struct<cell: long, clusters: binary>>"))
    near = near.select(*Q_COLS, "_v", F.explode("_cells").alias("_in"))
    return near.select(*Q_COLS, "_v", F.col("_in.cell").alias("_cell"), F.col("_in.clusters").alias("_in"))


def _kind(df: DataFrame, col: str) -> str:
    """Vectors travel as floats if that is what they are: half the bytes, the same numbers."""
    t = df.select(col).schema[0].dataType
    return "array<float>" if isinstance(t.elementType, FloatType) else "array<double>"


def _search(rows: DataFrame, vec_col: str, q: DataFrame, q_kind: str, idx: ClusterIndex, nprobe: int, block_bytes: int) -> DataFrame:
    """``tile_topk`` of the rows (id, the vector, cluster) and the queries of ``distinct_queries``.  Clusters are gathered into cells of about
    ``block_bytes`` of vectors as doubles: a query travels once to a cell and not once to each of its clusters there, and a
    tile gives its best rows of all of them.  One number for each cluster reaches the driver."""
    rows = rows.where(F.col("id").isNotNull())
    spark, (n, dim) = rows.sparkSession, idx.centroids.shape
    sizes = np.zeros(n, dtype=np.int64)
    for r in rows.groupBy("cluster").count().collect():
        sizes[r["cluster"]] = r["count"]
    block_rows, cores = max(1, block_bytes // (8 * dim)), spark.sparkContext.defaultParallelism
    cell = _cells(sizes, block_rows, cores)
    of = spark.createDataFrame(list(zip(range(n), cell.tolist())), "cluster int, _cell long")
    c = rows.join(F.broadcast(of), "cluster").select("id", F.xxhash64("id").alias("_row"), F.col(vec_col).cast(_kind(rows, vec_col)).alias("_v"),
                                                    "_cell", (F.col("cluster") - F.col("_cell")).cast("int").alias("_at"))
    q = _probed(q, idx, nprobe, cell, q_kind)
    blocks = {int(x): -(-int(sizes[cell == x].sum()) // block_rows) for x in np.unique(cell[sizes > 0])}
    cells = spark.createDataFrame(list(blocks.items()), "_cell long, _cbs long")
    small = -(-TILES * cores // max(1, sum(blocks.values())))
    cells = q.groupBy("_cell").count().join(F.broadcast(cells), "_cell")
    cells = cells.select("_cell", "_cbs", F.greatest(F.ceil(F.col("count") / block_rows), F.least(F.lit(small), F.ceil(F.col("count") / 1_000))).cast("long").alias("_qbs"))
    return tiled(c, q, "cosine", cells, max(blocks.values(), default=1) == 1)


def choose_nprobe(corpus: DataFrame, queries: DataFrame, index: ClusterIndex, k: int = 5, *, min_recall: float = MIN_RECALL,
                  sample: int = SAMPLE_QUERIES, id_col: str = "id", vec_col: str = "embedding",
                  qid_col: str = "qid", qvec_col: str = "embedding") -> int:
    """The least ``nprobe`` whose recall@k reaches ``min_recall`` by two standard errors.

    ``sample`` queries, chosen by a hash of their id, are answered by exact
    search over the whole corpus; a true neighbour is found by ``nprobe``
    exactly if its cluster is among the query's ``nprobe`` nearest."""
    spark, dim = corpus.sparkSession, index.centroids.shape[1]
    q = distinct_queries(queries, F.lit(int(k)), qid_col, qvec_col).where(F.size("_v") == dim).select("qid", F.col("_v").alias("qvec"))
    some = q.where("qid is not null").orderBy(F.xxhash64("qid", F.lit(7)), "qid").limit(sample).collect()
    some = list({r["qid"]: r for r in some}.values())
    if not some:
        return 1
    q = spark.createDataFrame([(r["qid"], r["qvec"]) for r in some], "qid long, embedding array<double>")
    rows = (corpus.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) == dim) & finite_vector(vec_col))
            .select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("embedding")))
    hits = topk_batch(rows, q, k).select("qid", "id").distinct().collect()       # sample x k rows
    if not hits:
        return 1
    ids = spark.createDataFrame([(x,) for x in sorted({r["id"] for r in hits})], "id long")
    found: dict[int, list[int]] = {}
    for r in index.assign(rows.join(F.broadcast(ids), "id")).select("id", "cluster").distinct().collect():
        found.setdefault(r["id"], []).append(r["cluster"])
    unit, _ = unit_rows(np.array([r["qvec"] for r in some], dtype=np.float64))
    place = np.argsort(np.argsort(-(unit @ index.centroids.T), axis=1, kind="stable"), axis=1)
    at = {r["qid"]: j for j, r in enumerate(some)}
    j = np.array([at[r["qid"]] for r in hits])
    need = np.array([place[at[r["qid"]], found[r["id"]]].max() + 1 for r in hits])
    of = np.bincount(j, minlength=len(some))
    for p in range(1, index.centroids.shape[0]):
        r = (np.bincount(j[need <= p], minlength=len(some)) / np.maximum(of, 1))[of > 0]
        if r.mean() - 2 * r.std() / math.sqrt(len(r)) >= min_recall:
            return p
    return index.centroids.shape[0]


def ann_topk(corpus: DataFrame, queries: DataFrame, k: int = 5, *, index: ClusterIndex | None = None,
             n_clusters: int | None = None, nprobe: int | None = None, id_col: str = "id", vec_col: str = "embedding",
             qid_col: str = "qid", qvec_col: str = "embedding", seed: int = 1,
             block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Approximate (qid, rank, id, similarity), rank <= k.  Clusters are
    assigned on the fly (JVM-side), so the whole corpus is read; a corpus
    stored with ``write_clustered`` is searched by ``ann_topk_stored``,
    which reads only the probed clusters' files.  Unless ``nprobe`` is given,
    ``choose_nprobe`` measures it on these queries."""
    idx = index or build_index(corpus, n_clusters, vec_col=vec_col, seed=seed)
    if nprobe is None:
        nprobe = choose_nprobe(corpus, queries, idx, int(k), id_col=id_col, vec_col=vec_col, qid_col=qid_col, qvec_col=qvec_col)
    dim = idx.centroids.shape[1]
    assigned = idx.assign(corpus.where(F.col(vec_col).isNotNull() & (F.size(vec_col) == dim) & finite_vector(vec_col))
                          .select(F.col(id_col).cast("long").alias("id"), vec_col), vec_col)
    q = distinct_queries(queries, F.lit(int(k)), qid_col, qvec_col)
    return answers(_search(assigned, vec_col, q, _kind(queries, qvec_col), idx, nprobe, block_bytes), id_col)


# --- stored, cluster-partitioned corpus --------------------------------------

def save_index(index: ClusterIndex, path: str) -> None:
    """Persist the centroids (the KMeans model) in a shared folder."""
    index.model.write().overwrite().save(path)


def load_index(path: str) -> ClusterIndex:
    m = KMeansModel.load(path)
    return ClusterIndex(m, np.vstack(m.clusterCenters()))


def write_clustered(corpus: DataFrame, index: ClusterIndex, path: str, *, id_col: str = "id",
                    vec_col: str = "embedding", carry: tuple[str, ...] = (),
                    rows_per_file: int = 1_000_000) -> None:
    """Store the corpus partitioned by cluster id (``partitionBy``), so a
    search reads only its probed clusters' folders.

    Each cluster is spread over ``ceil(size / rows_per_file)`` write tasks,
    from per-cluster counts (one row per cluster, broadcast), so a cluster
    holding a third of all rows is written by many tasks, not one, and
    every folder holds files of bounded size."""
    dim = index.centroids.shape[1]
    a = index.assign(corpus.where(F.col(vec_col).isNotNull() & (F.size(vec_col) == dim) & finite_vector(vec_col))
                     .select(F.col(id_col).cast("long").alias("id"), vec_col, *carry), vec_col)
    a = a.select("id", vec_col, *carry, F.col("cluster").cast("int"))
    sizes = a.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    salts = sizes.select("cluster", F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(rows_per_file)))
                         .cast("int").alias("_s"))
    n_tasks = max(1, int(salts.agg(F.sum("_s")).first()[0] or 1))
    spread_rows = (a.join(F.broadcast(salts), "cluster")       # one row per cluster
                   .withColumn("_salt", F.pmod(F.xxhash64("id"), F.col("_s")))
                   .repartition(n_tasks, "cluster", "_salt")
                   .drop("_s", "_salt"))
    spread_rows.write.mode("overwrite").partitionBy("cluster").parquet(path)


def ann_topk_stored(spark, path: str, index: ClusterIndex, queries: DataFrame, k: int = 5, *,
                    nprobe: int | None = None, id_col: str = "id", vec_col: str = "embedding",
                    qid_col: str = "qid", qvec_col: str = "embedding",
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """V1 over a corpus stored by ``write_clustered``: only the clusters that some query
    probes are read (a partition filter on ``cluster``, pruned at planning; at most as many
    numbers as there are clusters reach the driver), then scored and ranked as in ``ann_topk``.
    Unless given, ``nprobe`` is the one that ``choose_nprobe`` measures on these queries against the stored rows."""
    stored = spark.read.parquet(path)
    if nprobe is None:
        nprobe = choose_nprobe(stored.drop("cluster"), queries, index, int(k), vec_col=vec_col, qid_col=qid_col, qvec_col=qvec_col)
    q = distinct_queries(queries, F.lit(int(k)), qid_col, qvec_col)
    cells = sorted(r["_cell"] for r in _probed(q, index, nprobe).select("_cell").distinct().collect())
    rows = stored.where(F.col("cluster").isin(cells)).select(F.col("id").cast("long").alias("id"), vec_col, "cluster")
    return answers(_search(rows, vec_col, q, _kind(queries, qvec_col), index, nprobe, block_bytes), id_col)


def scanned_share(corpus: DataFrame, index: ClusterIndex, queries_probes: int, *, vec_col="embedding") -> float:
    """Expected fraction of corpus rows scored per query for nprobe clusters,
    from cluster sizes (one small aggregate)."""
    sizes = index.assign(corpus, vec_col).groupBy("cluster").count().orderBy(F.col("count").desc()).collect()
    total = sum(r["count"] for r in sizes)
    return sum(r["count"] for r in sizes[:queries_probes]) / total if total else 0.0


def recall_at_k(approx: DataFrame, exact: DataFrame) -> float:
    """Share of exact (qid, id) hits the approximate search also returned."""
    a = approx.select("qid", "id").distinct()
    e = exact.select("qid", "id").distinct()
    both = e.join(a, ["qid", "id"], "inner").count()
    total = e.count()
    return both / total if total else 1.0 if math.isfinite(total) else 0.0
