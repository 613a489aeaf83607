"""The stored history answers as the full form; clearing touches one bucket."""
import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from ragtide.operators import history, stored_history as sh

SCHEMA = "session_id long, seq long, query string, answer string, ts timestamp_ntz"


def _turns(seed, lo, hi):
    rng = random.Random(seed)
    t = datetime.datetime(2024, 1, 1)
    return [(s, q, f"q{rng.randrange(99)}", rng.choice(("a", None)), t) for s in (None, -5, 1, 2, 3, 2 ** 60) for q in range(lo, hi * (3 if s == 1 else 1))]


def _files(path, folder):
    return {b: sorted(os.listdir(os.path.join(path, folder, b))) for b in os.listdir(os.path.join(path, folder)) if b.startswith("bucket=")}


def _sorted(df):
    return sorted(map(str, df.collect()))


def test_appends_and_clears_equal_the_full_form(spark, scratch):
    path, buckets = f"{scratch}/h", 4
    first, more = _turns(1, 0, 6), [(s, q + 100, *r) for s, q, *r in _turns(2, 0, 7) if s != 2] + [(77, 1, "x", "y", datetime.datetime(2024, 2, 1))]
    sh.write_history(spark.createDataFrame(first, SCHEMA), path, buckets)
    sh.append_history(spark.createDataFrame(more, SCHEMA), path, buckets)
    full = spark.createDataFrame(first + more, SCHEMA)
    for n in (10, 2):
        assert _sorted(sh.last_n(spark, path, n)) == _sorted(history.history_last_n(full, n))
    sh.rebuild_last(spark, path)
    assert _sorted(sh.last_n(spark, path)) == _sorted(history.history_last_n(full))
    one = sh.last_n(spark, path, session_id=1, buckets=buckets)
    assert _sorted(one) == _sorted(history.history_last_n(full).where("session_id = 1"))
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString()
    before = {f: _files(path, f) for f in ("rows", "last")}
    sh.clear_session(spark, path, 1, buckets)
    after = {f: _files(path, f) for f in ("rows", "last")}
    b = spark.range(1).select(sh._bucket(F.lit(1).cast("long"), buckets)).first()[0]
    for f in before:
        assert [k for k in before[f] if before[f][k] != after[f][k]] == [f"bucket={b}"]
    cleared = history.clear_history(full, 1)
    assert _sorted(sh.last_n(spark, path)) == _sorted(history.history_last_n(cleared))
    assert _sorted(sh.all_rows(spark, path)) == _sorted(cleared)
    assert sum(r["session_id"] is None for r in sh.all_rows(spark, path).collect()) == 13
    for s in (-5, 2, 3, 2 ** 60, 77, 12345):           # buckets may be left without a row
        sh.clear_session(spark, path, s, buckets)
    assert sh.last_n(spark, path).count() == 0 and sh.all_rows(spark, path).count() == 13
    sh.append_history(spark.createDataFrame(first, SCHEMA).where("session_id is not null"), path, buckets)
    assert _sorted(sh.last_n(spark, path)) == _sorted(history.history_last_n(spark.createDataFrame(first, SCHEMA).where("session_id is not null")))
    with pytest.raises(ValueError):
        sh.last_n(spark, path, 11)
