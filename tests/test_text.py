"""Scalar text rules."""
from datetime import datetime

from pyspark.sql import functions as F

from ragtide.functions.text import (
    LENGTH_LABELS_FR, LENGTH_LABELS_RANGE, PY_WS, chunk_array, is_blank, iso_timestamp,
    length_category, line_count, normalize_newlines, preview, py_strip, rounded_avg_display, snippet,
)


def one(spark, expr, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_py_strip_matches_python(spark):
    samples = ["\t a  ", "​x​", "﻿y", "  　z  ", "", "\x1c\x1fq\x85"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r["r"] for r in df.select(py_strip("s").alias("r")).collect()]
    assert got == [s.strip() for s in samples]
    assert len(PY_WS) == 29


def test_blank_detection(spark):
    df = spark.createDataFrame([("\t  ",), (" a ",)], "s string")
    assert [r["b"] for r in df.select(is_blank("s").alias("b")).collect()] == [True, False]


def test_chunk_boundaries(spark):
    cases = {0: 0, 1: 1, 499: 1, 500: 1, 501: 2, 1000: 2}
    rows = [("x" * n,) for n in cases]
    got = [r["n"] for r in spark.createDataFrame(rows, "s string")
           .select(F.size(chunk_array("s")).alias("n")).collect()]
    assert got == list(cases.values())


def test_chunk_astral_boundary(spark):
    s = "a" * 499 + "\U0001F600" + "bcd"
    got = one(spark, chunk_array(F.col("s")), s)
    assert got == [s[i:i + 500] for i in range(0, len(s), 500)]
    assert [len(x) for x in got] == [500, 3]


def test_chunks_concatenate_to_text(spark):
    s = ("Érable\n" * 300) + "fin"
    assert "".join(one(spark, chunk_array(F.col("s")), s)) == s


def test_preview_and_snippet(spark):
    assert one(spark, preview(F.col("s"), 200), "x" * 200) == "x" * 200
    assert one(spark, preview(F.col("s"), 200), "x" * 201) == "x" * 200 + "..."
    assert one(spark, snippet(F.col("s"), 80), "short") == "short..."


def test_length_categories_edges(spark):
    lens = [49, 50, 99, 100, 199, 200, 499, 500]
    df = spark.createDataFrame([("y" * n,) for n in lens], "s string")
    fr = [r["c"] for r in df.select(length_category("s", LENGTH_LABELS_FR).alias("c")).collect()]
    rg = [r["c"] for r in df.select(length_category("s", LENGTH_LABELS_RANGE).alias("c")).collect()]
    idx = [0, 1, 1, 2, 2, 3, 3, 4]
    assert fr == [LENGTH_LABELS_FR[i] for i in idx]
    assert rg == [LENGTH_LABELS_RANGE[i] for i in idx]


def test_newlines_and_line_count(spark):
    assert one(spark, normalize_newlines(F.col("s")), "a\r\nb\rc") == "a\nb\nc"
    for text, n in [("a\nb", 2), ("a\nb\n", 2), ("", 0), ("x", 1), ("\n\n", 2)]:
        assert one(spark, line_count(F.col("s")), text) == n == len(text.splitlines(True))


def test_iso_timestamp(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 2, 3, 4, 5),), (datetime(2024, 1, 2, 3, 4, 5, 120),)],
                               "t timestamp_ntz")
    got = [r["r"] for r in df.select(iso_timestamp("t").alias("r")).collect()]
    assert got == ["2024-01-02T03:04:05", "2024-01-02T03:04:05.000120"]


def test_rounded_avg_display(spark):
    assert one(spark, rounded_avg_display(F.col("s")), 2.5, "s double") == 3
    assert one(spark, rounded_avg_display(F.col("s")), 2.49, "s double") == 2
