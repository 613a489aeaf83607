"""Ordered parts of page files against plain concatenation."""
import pytest
from pyspark.sql import functions as F

from ragtide.sources import pages as pages_src

SCHEMA = "file string, page_no long, text string"


def _rows():
    rows = [("big", n, f"page {n} " + "x" * (n % 37)) for n in range(1, 400)]
    rows += [(f"small{i}", n, "" if n == 2 else f"s{i}.{n}") for i in range(60) for n in (3, 2, 1)]
    return rows + [("long", 1, "a"), ("long", 2, "b" * 700), ("long", 3, "c"), ("blank", 1, " \t"), ("none", 1, None),
                   (None, 2, "no name, second"), (None, 1, "no name")]


def _want(rows, marked):
    kept = {}
    for f, n, t in sorted((r for r in rows if r[2] and r[2].strip()), key=lambda r: (r[0] or "", r[1])):
        kept.setdefault(f, []).append(f"--- Page {n} ---\n{t}\n" if marked else t)
    return {f: "\n".join(b) for f, b in kept.items()}


@pytest.mark.parametrize("marked", [False, True])
@pytest.mark.parametrize("ranges,batch", [("2", "10000"), ("13", "3")])
def test_parts_join_to_the_file(spark, marked, ranges, batch):
    rows = _rows()
    keys = {"spark.sql.shuffle.partitions": ranges, "spark.sql.execution.arrow.maxRecordsPerBatch": batch}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = pages_src.page_parts(spark.createDataFrame(rows, SCHEMA), marked=marked, part_chars=100).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    files = {}
    for r in sorted(got, key=lambda r: (r["file"] or "", r["part"])):
        assert r["start"] // 100 == r["part"]
        files.setdefault(r["file"], []).append(r)
    want = _want(rows, marked)
    assert {f: "\n".join(r["text"] for r in rs) for f, rs in files.items()} == want
    for rs in files.values():                    # starts are the places in the file
        at = 0
        for r in rs:
            assert r["start"] == at
            at += len(r["text"]) + 1
    assert sum(r["n_pages"] for r in got) == sum(1 for r in rows if r[2] and r[2].strip())


def test_pages_that_share_a_number_are_all_kept(spark):
    rows = [("f", 1, f"t{i % 7}") for i in range(50)] + [("f", None, "unnumbered")]
    got = pages_src.page_parts(spark.createDataFrame(rows, SCHEMA), part_chars=20).orderBy("part").collect()
    text = "\n".join(r["text"] for r in got).split("\n")
    assert text[0] == "unnumbered" and sorted(text[1:]) == sorted(r[2] for r in rows[:-1])


def test_empty_table_and_written_parts(spark, scratch):
    none = pages_src.page_parts(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0
    parts = pages_src.page_parts(spark.createDataFrame(_rows(), SCHEMA), part_chars=64)
    pages_src.write_extracted_text(parts, f"{scratch}/t")
    back = spark.read.parquet(f"{scratch}/t")
    assert back.columns == ["file", "part", "start", "text"] and back.count() == parts.count()


def test_a_file_with_most_pages_stays_in_many_tasks(spark):
    pages = spark.range(20_000).select(F.lit("one").alias("file"), F.col("id").alias("page_no"), F.lit("some text").alias("text"))
    got = pages_src.page_parts(pages, part_chars=1000)
    assert got.agg(F.sum("n_pages")).first()[0] == 20_000 and got.agg(F.max(F.length("text"))).first()[0] < 1010
