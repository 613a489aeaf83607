"""Merged statistics equal the full scan after several loads, reruns included."""
import datetime
import random

from pyspark.sql import functions as F

from ragtide.functions.text import LENGTH_LABELS_RANGE
from ragtide.operators import stat_states, stats

SCHEMA = "corpus string, file_name string, file_type string, created_at timestamp_ntz"


def _rows(seed, n):
    rng = random.Random(seed)
    t = datetime.datetime(2024, 1, 1)
    return [("x" * rng.choice((0, 1, 49, 50, 99, 100, 199, 200, 500, 700)), rng.choice(("a", "b", "c", None, f"f{seed}")),
             rng.choice(("txt", "pdf", None)), t + datetime.timedelta(seconds=rng.randrange(10 ** 6))) for _ in range(n)]


def _same(a, b):
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_merged_equals_full_scan(spark, scratch):
    loads = [_rows(k, n) for k, n in ((1, 300), (2, 1), (3, 500))]
    path = f"{scratch}/states"
    for k, rows in enumerate(loads):
        stat_states.write_states(spark.createDataFrame(rows[:7], SCHEMA), path, f"l{k}")     # a load that stopped
        stat_states.write_states(spark.createDataFrame(rows, SCHEMA), path, f"l{k}")         # and ran again
    full, st = spark.createDataFrame(sum(loads, []), SCHEMA), stat_states.read_states(spark, path)
    _same(stat_states.corpus_stats(st), stats.corpus_stats(full))
    _same(stat_states.stats_display(st), stats.stats_display(full))
    _same(stat_states.length_histogram(st), stats.length_histogram(full))
    _same(stat_states.length_histogram(st, LENGTH_LABELS_RANGE), stats.length_histogram(full, LENGTH_LABELS_RANGE))
    _same(stat_states.type_counts(st), stats.type_counts(full))
    _same(stat_states.file_distribution(st), stats.file_distribution(full))


def test_empty_and_null_texts(spark):
    none = spark.createDataFrame([], SCHEMA)
    st = stat_states.load_states(none)
    _same(stat_states.corpus_stats(st), stats.corpus_stats(none))
    odd = spark.createDataFrame([(None, "a", "txt", None), ("xy", "a", None, None)], SCHEMA)
    _same(stat_states.corpus_stats(stat_states.load_states(odd)), stats.corpus_stats(odd))
    assert [tuple(r) for r in stat_states.length_histogram(stat_states.load_states(odd)).collect()] == [("Très court (<50)", 1, 2)]
