"""Vector scoring and top-k."""
import math

import numpy as np
from pyspark.sql import functions as F

from ragtide.functions.vector import cosine_distance, l2_distance, parse_vector, vector_is_valid
from ragtide.operators import tiles, topk
from ragtide.sources.tables import stored_vectors
from conftest import SF_SMALL


def test_zero_vector_distance_is_one(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<double>, b array<double>")
    got = [r["d"] for r in df.select(cosine_distance("a", "b").alias("d")).collect()]
    assert got[0] == 1.0 and abs(got[1]) < 1e-12


def test_l2(spark):
    df = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(l2_distance("a", "b").alias("d")).first()["d"] == 5.0


def test_parse_vector_forms(spark):
    df = spark.createDataFrame([("[0.1,0.2,0.3]",), ("{0.1,0.2,0.3}",), ("[1,oops]",), ("nope",)], "s string")
    out = df.select(parse_vector("s").alias("v")).select("v", vector_is_valid("v").alias("ok")).collect()
    assert out[0]["v"] == [0.1, 0.2, 0.3] and out[1]["v"] == [0.1, 0.2, 0.3]
    assert [r["ok"] for r in out] == [True, True, False, False]


def _corpus(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, [0.7, 0.7]), (6, None)]
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def test_ties_lower_id_first_and_zero_rows(spark):
    c = _corpus(spark)
    single = topk.topk_single(c, [1.0, 0.0], 3).collect()
    assert [r["id"] for r in single] == [1, 3, 5]
    q = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 0.0])], "qid long, embedding array<float>")
    batch = topk.topk_batch(c, q, 5).orderBy("qid", "rank").collect()
    assert [r["id"] for r in batch if r["qid"] == 10] == [1, 3, 5, 2, 4]
    # a zero query scores 0 against everything: ties broken by id
    assert [r["id"] for r in batch if r["qid"] == 11] == [1, 2, 3, 4, 5]
    assert all(r["similarity"] == 0.0 for r in batch if r["qid"] == 11)


def test_per_query_k_and_zero_k(spark):
    c = _corpus(spark)
    q = spark.createDataFrame([(1, [1.0, 0.0], 2), (2, [0.0, 1.0], 0)], "qid long, embedding array<float>, top_k int")
    out = topk.topk_batch(c, q, k_col="top_k").collect()
    assert sorted((r["qid"], r["rank"]) for r in out) == [(1, 1), (1, 2)]


def test_batch_equals_single_and_numpy(spark):
    v = stored_vectors(spark, SF_SMALL)
    q = v.where(F.col("id") < 7).select(F.col("id").alias("qid"), "embedding")
    batch = topk.topk_batch(v, q, 5).collect()
    mat = np.array([r["embedding"] for r in v.orderBy("id").collect()], dtype=np.float64)
    ids = np.array([r["id"] for r in v.orderBy("id").collect()])
    unit = mat / np.linalg.norm(mat, axis=1)[:, None]
    for qid in range(7):
        sims = unit @ unit[qid]
        order = sorted(range(len(ids)), key=lambda i: (-sims[i], ids[i]))[:5]
        got = sorted((r for r in batch if r["qid"] == qid), key=lambda r: r["rank"])
        assert [r["id"] for r in got] == [int(ids[i]) for i in order]
        assert all(math.isclose(r["similarity"], sims[i], abs_tol=1e-9) for r, i in zip(got, order))
        single = topk.topk_single(v, mat[qid].tolist(), 5).collect()
        assert [r["id"] for r in single] == [r["id"] for r in got]


def test_query_blocks_split_when_over_bound(spark):
    v = stored_vectors(spark, SF_SMALL)
    q = v.select(F.col("id").alias("qid"), "embedding")
    small_bound = 64 * 8 * 60      # forces several blocks on either side
    a = {(r["qid"], r["rank"], r["id"]) for r in topk.topk_batch(v, q, 3, block_bytes=small_bound).collect()}
    b = {(r["qid"], r["rank"], r["id"]) for r in topk.topk_batch(v, q, 3).collect()}
    assert a == b and len(a) == 3 * v.count()


def test_l2_topk_matches_numpy(spark):
    v = stored_vectors(spark, SF_SMALL)
    q = v.where(F.col("id") < 3).select(F.col("id").alias("qid"), "embedding")
    out = topk.topk_batch(v, q, 4, metric="l2").collect()
    rows = v.orderBy("id").collect()
    mat = np.array([r["embedding"] for r in rows], dtype=np.float64)
    for qid in range(3):
        d = np.linalg.norm(mat - mat[qid], axis=1)
        want = sorted(range(len(rows)), key=lambda i: (d[i], rows[i]["id"]))[:4]
        got = sorted((r for r in out if r["qid"] == qid), key=lambda r: r["rank"])
        assert [r["id"] for r in got] == [rows[i]["id"] for i in want]


def test_topk_mask_keeps_exactly_k_with_ties():
    import numpy as np
    rng = np.random.default_rng(3)
    score = np.round(rng.random((500, 7)), 1)          # many ties
    score[:, 0] = 0.0                                  # a column where every row ties
    for kk in (1, 3, 10, 499, 500, 600):
        m = tiles.topk_mask(score, kk)
        assert (m.sum(axis=0) == min(kk, 500)).all()
        for j in range(score.shape[1]):
            want = sorted(range(500), key=lambda i: (-score[i, j], i))[:kk]
            assert set(np.nonzero(m[:, j])[0]) == set(want)


def test_zero_query_ships_k_candidates_per_batch(spark):
    # 3,000 identical rows in shuffled id order: every row ties for a zero query
    rows = [(int(i), [1.0, 1.0]) for i in (np.arange(3000) * 7919) % 3000 + 1]
    c = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(4)
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], "qid long, embedding array<float>")
    out = topk.topk_batch(c, q, 4).orderBy("qid", "rank").collect()
    assert [r["id"] for r in out if r["qid"] == 1] == [1, 2, 3, 4]
    assert [r["id"] for r in out if r["qid"] == 2] == [1, 2, 3, 4]


def test_task_topk_keeps_best_k_per_query_across_batches():
    import pyarrow as pa
    rng = np.random.default_rng(5)
    ks = np.array([1, 3, 5, 0])
    acc = topk.TaskTopK(ks, n_carry=1, budget=30)        # prunes many times along the way
    allrows = []
    for b in range(40):
        n = 50
        qi = rng.integers(0, 4, n)
        ids = rng.permutation(10_000)[:n] + b * 10_000
        sc = np.round(rng.random(n), 2)
        acc.add(qi, ids, sc, [pa.array([f"t{i}" for i in ids])])
        allrows += list(zip(qi, ids, sc))
    qi, ids, sc, (txt,) = acc.result()
    got = sorted(zip(qi.tolist(), ids.tolist(), sc.tolist()))
    want = []
    for q in range(4):
        best = sorted([r for r in allrows if r[0] == q], key=lambda r: (-r[2], r[1]))[:ks[q]]
        want += [(int(a), int(b), float(c)) for a, b, c in best]
    assert got == sorted(want)
    assert txt.to_pylist() == [f"t{i}" for i in ids]


def test_score_corpus_equals_jvm_expressions(spark):
    v = stored_vectors(spark, SF_SMALL)
    zero = spark.createDataFrame([(10_000, [0.0] * 64, 0)], "id long, embedding array<float>, label int")
    c = v.unionByName(zero)
    qv = topk.vector_of(v, 3)
    got = {r["id"]: r for r in topk.score_corpus(c, qv).collect()}
    lit = F.array(*[F.lit(x) for x in qv])
    want = {r["id"]: r for r in c.select("id", cosine_distance("embedding", lit).alias("d"),
                                           l2_distance("embedding", lit).alias("l2")).collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        assert math.isclose(r["distance"], want[i]["d"], abs_tol=1e-12)
        assert math.isclose(r["l2_distance"], want[i]["l2"], abs_tol=1e-12)
    assert got[10_000]["distance"] == 1.0 and got[10_000]["similarity"] == 0.0


def test_batch_topk_many_arrow_batches_matches_numpy(spark):
    """Small Arrow batches: every task accumulates its top-k over many
    batches; integer coordinates make many ties; one query is zero."""
    rng = np.random.default_rng(11)
    vecs = rng.integers(-2, 3, size=(400, 3)).astype(float)
    c = spark.createDataFrame([(int(i) + 1, v.tolist()) for i, v in enumerate(vecs)],
                              "id long, embedding array<double>").repartition(3)
    qs = np.vstack([rng.integers(-2, 3, size=(6, 3)).astype(float), np.zeros((1, 3))])
    ks = [3, 1, 5, 0, 7, 2, 4]
    q = spark.createDataFrame([(i, v.tolist(), ks[i]) for i, v in enumerate(qs)],
                              "qid long, embedding array<double>, top_k int")
    prev = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = {(r["qid"], r["rank"], r["id"], round(r["similarity"], 12))
               for r in topk.topk_batch(c, q, k_col="top_k").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", prev)
    norms = np.linalg.norm(vecs, axis=1)
    want = set()
    for i, qv in enumerate(qs):
        qn = np.linalg.norm(qv)
        sims = [0.0 if n == 0 or qn == 0 else float(v @ qv / (n * qn)) for v, n in zip(vecs, norms)]
        order = sorted(range(len(vecs)), key=lambda j: (-round(sims[j], 12), j))[:ks[i]]
        want |= {(i, r + 1, j + 1, round(sims[j], 12)) for r, j in enumerate(order)}
    assert got == want


def test_mixed_dimensions_and_components_that_are_no_numbers(spark):
    """Queries meet the rows of their own dimension; a null, NaN or infinite
    component keeps a vector out and costs no other row its place."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [nan, 1.0]), (3, [None, 1.0]), (4, [0.0, 1.0]), (5, [inf, 0.0]), (6, [1.0, 1.0]),
            (7, [1.0, 0.0, 0.0]), (8, None), (9, [])]
    c = spark.createDataFrame(rows, "id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, [nan, 1.0]), (5, None), (6, [1.0])],
                              "qid long, embedding array<double>")
    for k in (2, 5):
        got = {}
        for r in topk.topk_batch(c, q, k).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append(r["id"])
        assert got == {1: [1, 6, 4][:k], 2: [4, 6, 1][:k], 3: [7]}
        assert [r["id"] for r in topk.topk_single(c, [1.0, 0.0], k).orderBy("rank").collect()] == [1, 6, 4][:k]


def test_tiles_equal_numpy_with_several_blocks(spark):
    """Both metrics over 5 x 9 blocks, ids in a third of all rows equal, per-query k."""
    rng = np.random.default_rng(2)
    ids = [7 if i < 90 else 1000 + i for i in range(270)]
    for metric, col in (("cosine", "similarity"), ("l2", "distance")):
        # whole numbers make many equal distances; cosines of them differ in the last bits, so those are of any numbers
        draw = (lambda n: rng.normal(size=(n, 4))) if metric == "cosine" else (lambda n: rng.integers(-3, 4, (n, 4)).astype(float))
        vecs, qs = draw(270), draw(60)
        c = spark.createDataFrame([(ids[i], v.tolist(), f"t{i}") for i, v in enumerate(vecs)], "id long, embedding array<double>, t string").repartition(4)
        q = spark.createDataFrame([(i, v.tolist(), 1 + i % 6) for i, v in enumerate(qs)], "qid long, embedding array<double>, k int")
        out = topk.topk_batch(c, q, k_col="k", metric=metric, carry=["t"], block_bytes=30 * 32).collect()
        assert len(out) == sum(1 + i % 6 for i in range(60)) and len({(r["qid"], r["rank"]) for r in out}) == len(out)
        for i, v in enumerate(qs):
            n = np.linalg.norm(vecs, axis=1) * np.linalg.norm(v)
            score = np.where(n > 0, vecs @ v / np.where(n > 0, n, 1), 0) if metric == "cosine" else np.linalg.norm(vecs - v, axis=1)
            want = sorted((round(float(-s if metric == "cosine" else s), 9), ids[j]) for j, s in enumerate(score))[: 1 + i % 6]
            mine = sorted((r for r in out if r["qid"] == i), key=lambda r: r["rank"])
            assert [(round(-r[col] if metric == "cosine" else r[col], 9), r["id"]) for r in mine] == want
            assert all(ids[int(r["t"][1:])] == r["id"] and abs(score[int(r["t"][1:])] - r[col]) < 1e-9 for r in mine)


def test_null_ids_and_equal_qids(spark):
    """A row without an id takes no part and changes no other id; queries that share a qid are answered each on its own."""
    big = 2**60
    c = spark.createDataFrame([(big + 1, [1.0, 0.0]), (None, [1.0, 0.0]), (big + 3, [1.0, 0.1]), (5, [0.0, 1.0])], "id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [1.0, 0.0])], "qid long, embedding array<double>")
    got = sorted(((r["qid"], r["rank"], r["id"]) for r in topk.topk_batch(c, q, 2).collect()), key=str)
    assert got == sorted([(1, 1, big + 1), (1, 2, big + 3)] + 2 * [(1, 1, 5), (1, 2, big + 3)] + [(None, 1, big + 1), (None, 2, big + 3)], key=str)
    assert [r["id"] for r in topk.topk_single(c, [1.0, 0.0], 2).collect()] == [big + 1, big + 3]
    bad = c.unionByName(spark.createDataFrame([(9, [float("nan"), 1.0])], "id long, embedding array<double>"))
    assert {r["id"] for r in topk.score_corpus(bad, [1.0, 0.0]).collect()} == {big + 1, big + 3, 5}


def test_validity_takes_finite_numbers_alone(spark):
    rows = [("[1,2]", True), ("[1,NaN]", False), ("[Infinity,1]", False), ("[-Infinity]", False), ("[1,x]", False)]
    df = spark.createDataFrame(rows, "s string, want boolean").select("want", vector_is_valid(parse_vector("s")).alias("ok"))
    assert all(r["ok"] == r["want"] for r in df.collect())


def test_best_equals_a_full_sort(monkeypatch):
    """Copies, zero vectors, differing k, rows that come ever nearer, several blocks: as a sort of all scores; most of them are not looked at."""
    rng = np.random.default_rng(3)
    rows = rng.integers(-2, 3, size=(700, 4)).astype(float)
    rows[40:300] = rows[5]
    rows[9] = 0
    near = np.sort(rng.random(700))[::-1, None] * [1.0, 2.0, 3.0, 4.0]
    queries = np.concatenate([rows[:60], np.zeros((1, 4)), rng.normal(size=(30, 4))])
    ks = rng.integers(1, 9, len(queries))
    seen, mask = [], tiles.topk_mask
    monkeypatch.setattr(tiles, "topk_mask", lambda score, kk: seen.append(score.size) or mask(score, kk))
    for size in (1, 7, 64, 5000):
        monkeypatch.setattr(tiles, "QUERIES", size)
        monkeypatch.setattr(tiles, "ROWS", 3 * size)
        for corpus in (rows, near, rows[:3], rows[:0]):
            for metric in ("cosine", "l2"):
                m = tiles.METRICS[metric](queries, corpus)
                everything = slice(0, None)
                score = m.score(m.raw(everything, everything), np.arange(len(queries))[:, None])
                at, row, sim = tiles.best(queries, corpus, ks, metric)
                got = sorted(zip(at.tolist(), (-np.round(sim, 9)).tolist()))
                want = sorted((q, -s) for q in range(len(ks)) for s in np.round(np.sort(score[q])[::-1][: ks[q]], 9).tolist())
                assert np.allclose(np.array(got).reshape(-1, 2), np.array(want).reshape(-1, 2)) and np.allclose(sim, score[at, row])
    monkeypatch.undo()
    monkeypatch.setattr(tiles, "topk_mask", lambda score, kk: seen.append(score.size) or mask(score, kk))
    seen.clear()
    rows, queries = rng.normal(size=(20_000, 8)), rng.normal(size=(300, 8))
    at, row, _ = tiles.best(queries, rows, np.full(300, 5), "l2")
    assert sum(seen) < rows.shape[0] * queries.shape[0] / 50
    far = ((queries[:, None] - rows[None]) ** 2).sum(axis=2)
    want = np.argsort(far, axis=1, kind="stable")[:, :5]
    assert {(q, r) for q, w in enumerate(want) for r in w} == set(zip(at, row))
