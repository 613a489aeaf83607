"""W3 dense ids: equal to a global row_number, including a hot key."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from ragtide.operators.ids import dense_index


def test_dense_ids_with_hot_key(spark):
    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 1000).alias("k"),   # k=7 holds a third
        F.col("id").alias("j"))
    got = dense_index(df, ["k", "j"], "rid", num_ranges=8,
                      split_key=F.col("k") * 1e6 + F.col("j"))
    ref = df.withColumn("want", F.row_number().over(Window.orderBy("k", "j")))
    j = got.join(ref, ["k", "j"])
    assert j.where(F.col("rid") != F.col("want")).count() == 0
    assert got.agg(F.min("rid"), F.max("rid"), F.count_distinct("rid")).first() == (1, n, n)


def test_dense_ids_default_split_and_empty(spark):
    df = spark.createDataFrame([(5,), (1,), (3,)], "x long")
    assert [r["i"] for r in dense_index(df, ["x"], "i").orderBy("x").collect()] == [1, 2, 3]
    empty = spark.createDataFrame([], "x long")
    assert dense_index(empty, ["x"], "i").count() == 0


def test_in_order_splits_a_hot_key(spark):
    from ragtide.operators.ids import in_order, stored_ids
    for hot in (None, 7):                          # a third of all rows
        rows = [(hot if i % 3 == 0 else i, f"t{i * 7919 % 3000:04d}") for i in range(3000)]
        df = spark.createDataFrame(rows, "k long, t string").repartition(5)
        srt = in_order(df, ["k"], ["t"], num_ranges=8)
        assert max(r["count"] for r in srt.groupBy(F.spark_partition_id()).count().collect()) < 700
        got = [(r["k"], r["t"]) for r in stored_ids(srt, "id", "test").orderBy("id").collect()]
        assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_in_order_numeric_ranges_read_the_text_once(spark, scratch):
    from ragtide.operators.ids import in_order, stored_ids
    path = f"{scratch}/t"
    spark.range(5000).select((F.col("id") * 3).alias("k"), F.repeat(F.lit("x"), 20).alias("t")).write.parquet(path)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    df = spark.read.parquet(path)
    srt = in_order(df, ["k"], ["t"], num_ranges=8)
    assert "REPARTITION_BY_NUM" in srt._jdf.queryExecution().toString()
    assert "rangepartitioning" not in srt._jdf.queryExecution().toString()
    r = stored_ids(srt.mapInArrow(count, "k long, t string"), "id", "test")
    assert r.where(F.col("id") != F.col("k") / 3 + 1).count() == 0
    assert r.count() == 5000 and seen.value == 5000     # counted once: ids come from the stored rows


def test_numbered_chunks_match_global_numbering(spark):
    from ragtide.functions.text import PY_WS
    from ragtide.operators.chunking import chunk_documents, numbered_chunks
    ws = PY_WS * 40
    docs = [(1, "a" * 1000), (2, " \t "), (3, "x" + " " * 1200 + "y"), (4, "z" * 499 + "\U0001F600" + "w"),
            (5, "b" + ws[:499] + ws[:500] + "c"), (6, ""), (7, "q" * 501)]
    df = spark.createDataFrame(docs, "doc_id long, content string").repartition(3)
    got = numbered_chunks(df, ["doc_id"]).select("id", "doc_id", "chunk_index", "corpus")
    ref = (chunk_documents(df, keep=("doc_id",))
           .withColumn("want", F.row_number().over(Window.orderBy("doc_id", "chunk_index"))))
    j = got.join(ref, ["doc_id", "chunk_index", "corpus"])
    assert j.count() == ref.count() == got.count()
    assert j.where(F.col("id") != F.col("want")).count() == 0


def test_chunk_ids_on_test_table(spark):
    from conftest import SF_MED
    from ragtide.operators.chunking import numbered_chunks
    from ragtide.sources.tables import documents_as_files
    b = numbered_chunks(documents_as_files(spark, SF_MED), ["doc_id"]).select("id", "doc_id", "chunk_index")
    assert b.agg(F.min("id"), F.max("id"), F.count_distinct("id"), F.count(F.lit(1))).first() == \
        (1, 5332, 5332, 5332)
    w = b.withColumn("want", F.row_number().over(Window.orderBy("doc_id", "chunk_index")))
    assert w.where("id != want").count() == 0


def test_numbered_chunks_null_key_is_numbered(spark):
    from ragtide.operators.chunking import numbered_chunks
    df = spark.createDataFrame([(None, "x" * 600), ("a", "y"), ("b", "z")], "file string, content string")
    rows = sorted((r["id"], r["file"]) for r in numbered_chunks(df, ["file"]).collect())
    assert rows == [(1, None), (2, None), (3, "a"), (4, "b")]       # NULL sorts first
    assert numbered_chunks(df.limit(0), ["file"]).count() == 0


def test_ids_for_rows_equal_full_numbering(spark):
    from ragtide.operators.chunking import chunk_rows, ids_for_rows, numbered_chunks
    docs = [(None, "n" * 700), (5, "a" * 1200), (2, " \t "), (9, "x" + " " * 1200 + "y"), (7, "q")]
    df = spark.createDataFrame(docs, "doc_id long, content string").repartition(3)
    full = {(r["doc_id"], r["chunk_index"]): r["id"] for r in numbered_chunks(df, ["doc_id"]).collect()}
    rows = chunk_rows(df, ("doc_id",))
    for order in (["doc_id", "_pos"], [F.col("doc_id").desc(), F.col("_pos").desc()]):
        top = ids_for_rows(df, rows.orderBy(*order).limit(4), "doc_id")
        got = {(r["doc_id"], r["chunk_index"]): r["id"] for r in top.collect()}
        assert len(got) == 4 and all(full[k] == v for k, v in got.items())


def test_ids_for_rows_string_keys(spark):
    from ragtide.operators.chunking import chunk_rows, ids_for_rows, numbered_chunks
    docs = [(None, "n" * 700), ("b.txt", "a" * 1200), ("a.txt", " \t "), ("c.txt", "y"), ("ab.txt", "q" * 501)]
    df = spark.createDataFrame(docs, "file string, content string")
    full = {(r["file"], r["chunk_index"]): r["id"] for r in numbered_chunks(df, ["file"]).collect()}
    top = ids_for_rows(df, chunk_rows(df, ("file",)), "file")
    got = {(r["file"], r["chunk_index"]): r["id"] for r in top.collect()}
    assert got == full


def test_ids_for_rows_keys_beyond_double_precision(spark):
    from ragtide.operators.chunking import chunk_rows, ids_for_rows, numbered_chunks
    big = 2 ** 60
    df = spark.createDataFrame([(big, "a" * 600), (big + 1, "b"), (3, "c")], "doc_id long, content string")
    full = {(r["doc_id"], r["chunk_index"]): r["id"] for r in numbered_chunks(df, ["doc_id"]).collect()}
    got = {(r["doc_id"], r["chunk_index"]): r["id"]
           for r in ids_for_rows(df, chunk_rows(df, ("doc_id",)), "doc_id").collect()}
    assert got == full


def test_documents_that_share_a_key_are_numbered_once(spark):
    from ragtide.operators.chunking import numbered_chunks
    docs = [("a", "x" * 600), ("a", "y"), ("b", "z"), ("a", "y"), (None, "n"), (None, "n")]
    df = spark.createDataFrame(docs, "file string, content string").repartition(3)
    rows = numbered_chunks(df, ["file"]).collect()
    assert sorted(r["id"] for r in rows) == list(range(1, 8))
    assert sorted((r["file"] or "", r["corpus"]) for r in rows) == sorted(
        [("a", "x" * 500), ("a", "x" * 100), ("a", "y"), ("a", "y"), ("b", "z"), ("", "n"), ("", "n")])
    assert set(rows[0].asDict()) == {"id", "file", "chunk_index", "corpus"}
