"""V1 cluster-pruned search against exact search; P11 stand-in encoder."""
from pyspark.sql import functions as F

from ragtide.operators import ann, embed, topk
from ragtide.sources.tables import stored_vectors
from conftest import SF_MED, SF_SMALL


def test_ann_all_probes_equals_exact(spark):
    v = stored_vectors(spark, SF_MED)
    q = v.where(F.col("id") < 40).select(F.col("id").alias("qid"), "embedding")
    idx = ann.build_index(v, n_clusters=8)
    approx = ann.ann_topk(v, q, 5, index=idx, nprobe=8)
    exact = topk.topk_batch(v, q, 5)
    a = {(r["qid"], r["rank"], r["id"], round(r["similarity"], 9)) for r in approx.collect()}
    e = {(r["qid"], r["rank"], r["id"], round(r["similarity"], 9)) for r in exact.collect()}
    assert a == e


def test_ann_partial_probe_recall_and_share(spark):
    v = stored_vectors(spark, SF_MED)
    q = v.where(F.col("id") < 40).select(F.col("id").alias("qid"), "embedding")
    idx = ann.build_index(v, n_clusters=10)
    approx = ann.ann_topk(v, q, 5, index=idx, nprobe=5)
    exact = topk.topk_batch(v, q, 5)
    r = ann.recall_at_k(approx, exact)
    share = ann.scanned_share(v, idx, 5)
    assert 0.0 < r <= 1.0 and 0.0 < share <= 1.0
    # returned similarities are exact ones
    sims = {(x["qid"], x["id"]): x["similarity"] for x in topk.topk_batch(v, q, 2000).collect()}
    assert all(abs(x["similarity"] - sims[(x["qid"], x["id"])]) < 1e-9 for x in approx.collect())


def test_ann_default_probes_reach_the_recall_asked_for(spark):
    v = stored_vectors(spark, SF_MED.replace("sf0.01", "sf0.1"))
    q = v.select(F.col("id").alias("qid"), "embedding")
    r = ann.recall_at_k(ann.ann_topk(v, q, 5), topk.topk_batch(v, q, 5))
    assert r >= 0.9, r


def test_hashed_encoder_contract(spark):
    df = spark.createDataFrame([(1, "Élève inscrit à l'université"), (2, ""), (3, "élève ÉLÈVE")],
                               "id long, text string")
    out = {r["id"]: r["embedding"] for r in embed.embed(df, "text", "embedding").collect()}
    assert all(len(v) == embed.EMBEDDING_DIM for v in out.values())
    assert abs(sum(x * x for x in out[1]) - 1.0) < 1e-5
    assert all(x == 0.0 for x in out[2])                 # zero vector: distance 1.0 rule applies


def test_pandas_encoder_hook(spark):
    enc = embed.pandas_encoder(lambda texts: [[float(len(t)), 1.0] for t in texts], dim=2)
    df = spark.createDataFrame([(1, "abc")], "id long, text string")
    assert embed.embed(df, "text", "e", enc).first()["e"] == [3.0, 1.0]


def test_ann_in_many_blocks(spark):
    v = stored_vectors(spark, SF_MED)
    q = v.where(F.col("id") < 60).select(F.col("id").alias("qid"), "embedding")
    idx = ann.build_index(v, n_clusters=8)
    def rows(df):
        return {(r["qid"], r["rank"], r["id"], round(r["similarity"], 9)) for r in df.collect()}
    one = rows(ann.ann_topk(v, q, 3, index=idx, nprobe=3))
    many = rows(ann.ann_topk(v, q, 3, index=idx, nprobe=3, block_bytes=4096))
    assert one == many and len(one) == 180


def test_stored_clustered_corpus_search_and_pruning(spark, scratch):
    import contextlib
    import io
    import os
    v = stored_vectors(spark, SF_MED)
    q = v.where(F.col("id") < 30).select(F.col("id").alias("qid"), "embedding")
    idx = ann.build_index(v, n_clusters=8)
    ann.save_index(idx, os.path.join(scratch, "index"))
    idx2 = ann.load_index(os.path.join(scratch, "index"))
    assert (idx2.centroids == idx.centroids).all()
    path = os.path.join(scratch, "clustered")
    ann.write_clustered(v, idx2, path, rows_per_file=40)        # several files per cluster
    stored = spark.read.parquet(path)
    assert stored.count() == v.count()
    per_dir = {}
    for f in stored.inputFiles():
        per_dir.setdefault(f.split("/cluster=")[1].split("/")[0], []).append(f)
    assert len(per_dir) == 8 and max(len(x) for x in per_dir.values()) > 1

    def rows(df):
        return {(r["qid"], r["rank"], r["id"], round(r["similarity"], 9)) for r in df.collect()}
    assert rows(ann.ann_topk_stored(spark, path, idx2, q, 5, nprobe=3)) == \
        rows(ann.ann_topk(v, q, 5, index=idx, nprobe=3))
    # one query, one probe: the plan prunes to that cluster's folder
    one = q.where(F.col("qid") == 0)
    res = ann.ann_topk_stored(spark, path, idx2, one, 3, nprobe=1)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        res.explain("formatted")
    assert "PartitionFilters: [isnotnull(cluster" in buf.getvalue() and "cluster#" in buf.getvalue()
    assert len(res.collect()) == 3


def test_loaded_encoder_builds_model_on_workers(spark):
    def loader():
        import os
        pid = os.getpid()
        return lambda texts: [[float(len(t)), float(pid)] for t in texts]
    enc = embed.loaded_encoder("len-model", loader, dim=2)
    df = spark.range(200).select(F.col("id"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("text"))
    out = embed.embed(df.repartition(4), "text", "e", enc).collect()
    assert all(r["e"][0] == len(r["text"]) for r in out)
    # the model was built in the workers, not on the driver
    import os
    assert all(int(r["e"][1]) != os.getpid() for r in out)
    assert "len-model" not in embed._MODELS


def test_ann_handles_zero_vectors_in_the_corpus(spark, scratch):
    import os
    v = stored_vectors(spark, SF_SMALL)
    zeros = spark.createDataFrame([(90_000 + i, [0.0] * 64, 0) for i in range(3)],
                                  "id long, embedding array<float>, label int")
    c = v.unionByName(zeros)
    q = v.where(F.col("id") < 10).select(F.col("id").alias("qid"), "embedding")
    idx = ann.build_index(c, n_clusters=6)
    assert idx.assign(c).where(F.col("id") >= 90_000).select("cluster").distinct().collect()[0][0] == 0

    def rows(df):
        return {(r["qid"], r["rank"], r["id"], round(r["similarity"], 9)) for r in df.collect()}
    exact = rows(topk.topk_batch(c, q, 5))
    assert rows(ann.ann_topk(c, q, 5, index=idx, nprobe=6)) == exact
    path = os.path.join(scratch, "clustered")
    ann.write_clustered(c, idx, path)
    assert spark.read.parquet(path).count() == c.count()
    assert rows(ann.ann_topk_stored(spark, path, idx, q, 5, nprobe=6)) == exact


def test_ann_zero_query_gets_its_rows(spark):
    rows = [(i, [float(i % 3), float(i % 5), 1.0]) for i in range(40)] + [(40, [float("nan"), 1.0, 1.0])]
    c = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = spark.createDataFrame([(1, [0.0, 0.0, 0.0]), (2, [1.0, 2.0, 1.0])], "qid long, embedding array<double>")
    near = ann.ann_topk(c, q, 4, n_clusters=3, nprobe=3).select("qid", "rank", "id").collect()
    assert sorted(map(tuple, near)) == sorted(map(tuple, topk.topk_batch(c, q, 4).select("qid", "rank", "id").collect()))
    assert len(near) == 8


def test_probed_vectors_leave_python_once(spark, capsys):
    """A query's clusters are exploded by Spark, so a Python worker holds a query's vector once, however many clusters it probes."""
    import numpy as np
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 4)))] + [(300, [0.0] * 4)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    idx = ann.build_index(v, 6)
    q = ann.distinct_queries(v.withColumnRenamed("id", "qid"), F.lit(3), "qid", "embedding")
    p = ann._probed(q, idx, 4)
    p.explain()
    plan = capsys.readouterr().out
    assert "explode(_cells" in plan
    got = {}
    for r in p.collect():
        got.setdefault(r["qid"], []).append(r["_cell"])
    for i, vec in rows:
        near = np.argsort(-(np.array(vec) / (np.linalg.norm(vec) or 1.0) @ idx.centroids.T), kind="stable")[:4]
        assert sorted(got[i]) == sorted(near.tolist())


def _vectors(spark, n=600, dim=6):
    """Vectors with copies under other ids and under the same id, and zero ones."""
    import numpy as np
    rng = np.random.default_rng(4)
    v = rng.normal(size=(n, dim)).astype(np.float32)
    v[100:160], v[200:203] = v[7], 0
    ids = [5 if 300 <= i < 320 else 10 * i for i in range(n)]
    rows = [(i, [float(x) for x in vec]) for i, vec in zip(ids, v)]
    return rows, spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)


def test_a_query_travels_once_to_a_cell_of_clusters(spark, monkeypatch):
    """What leaves the tiles grows with the cells, not with the clusters that a query probes."""
    from ragtide.operators import tiles
    _, v = _vectors(spark)
    q = v.where("id > 5").select(F.col("id").alias("qid"), "embedding")
    seen, ranked = [], tiles._ranked
    monkeypatch.setattr(tiles, "_ranked", lambda cand, by: seen.append(cand) or ranked(cand, by))
    idx = ann.build_index(v, 30)
    ann.ann_topk(v, q, 3, index=idx, nprobe=20)
    assert seen[0].count() <= 580 * 3 * 2, seen[0].count()       # before, nearly 580 x 20 x 3
    assert seen[0].select("qid", "_cell").distinct().count() <= 580 * 2


def test_probed_clusters_in_cells_equal_numpy(spark, monkeypatch):
    """Every query is answered from the clusters it probes alone, whatever cells and blocks they are dealt to."""
    import numpy as np
    rows, v = _vectors(spark)
    idx = ann.build_index(v, 12)
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    at = {(r["id"], tuple(r["embedding"])): r["cluster"] for r in idx.assign(v).collect()}
    cluster = np.array([at[r[0], tuple(np.float32(r[1]).astype(float))] for r in rows])
    unit = m / np.maximum(np.linalg.norm(m, axis=1), 1e-30)[:, None]
    near = np.argsort(-(unit @ idx.centroids.T), axis=1, kind="stable")[:, :5]
    asked = [i for i in range(0, 600, 7) if ids[i] > 5] + [100, 201]
    q = spark.createDataFrame([(i, rows[i][1]) for i in dict.fromkeys(asked)], "qid long, embedding array<double>")
    want = {}
    for i in asked:
        score = np.where(np.isin(cluster, near[i]), unit @ unit[i], -9)
        want[i] = [round(float(x), 9) for x in np.sort(score)[::-1][:4] if x > -9]
    for cores, block in ((1, 1 << 20), (30, 1 << 20), (1, 100 * 48), (1, 20 * 48)):      # one cell, small ones, cells of blocks, clusters of several blocks
        monkeypatch.setattr(ann, "TILES", cores)
        got, first = {}, {}
        for r in ann.ann_topk(v, q, 4, index=idx, nprobe=5, block_bytes=block).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append(round(r["similarity"], 9))
            first.setdefault(r["qid"], []).append(r["id"])
        assert got == want
        assert first[100] == [70, 1000, 1010, 1020]            # equal vectors: by id
        assert first[201] == sorted(ids[np.isin(cluster, near[201])].tolist())[:4]


def test_best_of_parts_equals_a_full_sort():
    """Each query against the rows of its parts; equal rows of several parts, a part that nobody asks for, an empty set."""
    import numpy as np
    from ragtide.operators import tiles
    rng = np.random.default_rng(6)
    rows = rng.integers(-2, 3, size=(900, 4)).astype(np.float32)
    queries = np.concatenate([rows[:50], np.zeros((2, 4)), rng.normal(size=(500, 4))]).astype(np.float32)
    ks, at = rng.integers(1, 7, len(queries)), rng.choice([0, 1, 3, 8, 11], 900)
    asks = rng.random((len(queries), 12)) < 0.4
    asks[:, 8] = False
    for metric in ("cosine", "l2"):
        parts = tiles.Parts(at, np.packbits(asks, axis=1))
        who, place, sim = tiles.best(queries, rows[parts.place], ks, metric, parts)
        m = tiles.METRICS[metric](queries, rows)
        score = np.round(m.score(m.raw(slice(None), slice(None)), np.arange(len(queries))[:, None]), 9)
        score[~asks[:, at]] = -np.inf
        for i, k in enumerate(ks):
            mine = place[who == i]
            kept = np.argsort(-score[i], kind="stable")[:k]
            kept = kept[score[i][kept] > -np.inf]
            assert np.allclose(score[i][mine], score[i][kept])
            if metric == "l2" and i < 50:
                assert mine.tolist() == kept.tolist()            # whole numbers: equal distances are equal, so by place
    parts = tiles.Parts(at[:0], np.packbits(asks, axis=1))
    assert [len(x) for x in tiles.best(queries, rows[:0], ks, "cosine", parts)] == [0, 0, 0]


def test_cells_hold_runs_of_clusters():
    import numpy as np
    rng = np.random.default_rng(7)
    for sizes in (rng.integers(0, 90, 300), np.array([0, 0, 5000, 1, 0]), np.zeros(4, int), np.array([7])):
        for block, cores in ((10_000, 6), (700, 1), (1, 1)):
            cell = ann._cells(sizes, block, cores)
            assert (np.diff(cell) >= 0).all() and (cell[cell] == cell).all() and (cell <= np.arange(len(cell))).all()
            of = np.bincount(cell, sizes)
            assert (of <= np.maximum(block, sizes.max() + block)).all()
    assert len(np.unique(ann._cells(np.full(400, 1000), 131_072, 6))) == 5
