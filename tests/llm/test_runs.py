"""Runs of words against a direct search by every period."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ragtide.llm import queries, runs

from .test_llm import ODD, SMALL, docs, made, none, odd, words  # noqa: F401


def direct(t, least=12):
    """(start, length, period) of all runs, period by period."""
    n, out = len(t), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and t[i] == t[i + p]:
                i += 1
            if i + p - s >= max(least, 2 * p):
                out.setdefault((s, i + p), p)
            i += 1
    return sorted((s, e - s, p) for (s, e), p in out.items())


def some_text(rng):
    n, kind, a = rng.randint(0, 300), rng.randrange(7), rng.choice([2, 2, 3, 5, 50])
    unit = lambda most, k=a: [rng.randrange(k) for _ in range(rng.randint(1, most))]
    t: list = []
    if kind == 0:
        t = [rng.randrange(a) for _ in range(n)]
    elif kind == 1:                                     # stretches of all periods
        while len(t) < n:
            u = unit(30)
            t += u * rng.randint(1, 6) + u[: rng.randint(0, len(u))]
    elif kind == 2:                                     # Fibonacci words: runs inside runs
        x, t = [0], [0, 1]
        while len(t) < n:
            x, t = t, t + x
    elif kind == 3:
        t = [bin(i).count("1") % 2 for i in range(n)]
    elif kind == 4:                                     # highly periodic regions of one unit, out of phase
        u = unit(4, 2)
        while len(t) < n:
            t += (u * 60)[: rng.randint(5, 90)]
    else:                                               # periods that are highly periodic themselves
        v = (unit(5, 2) * 60)[: rng.randint(10, 90)]
        t = v * rng.randint(2, 6) + v[: rng.randint(0, len(v))]
    for _ in range(rng.choice([0, 0, 1, 3])):
        if t:
            t[rng.randrange(len(t))] = rng.randrange(a)
    return t


def test_search_finds_all_runs():
    rng = random.Random(11)
    for _ in range(40):
        texts = [some_text(rng) for _ in range(12)]
        for t, got in zip(texts, runs.search([np.array(t, np.int64) for t in texts])):
            assert [tuple(r) for r in got.tolist()] == direct(t), t
    assert [x.tolist() for x in runs.search([np.empty(0, np.int64), np.zeros(11, np.int64), np.zeros(12, np.int64)])] == [[], [], [[0, 12, 1]]]


def test_junctions_are_needed(monkeypatch):
    """Two highly periodic regions out of phase: their runs come from no pair of contexts alone."""
    t = np.array([0, 1] * 80 + [1, 0] * 80)
    whole = [tuple(r) for r in runs.search([t])[0].tolist()]
    assert whole == direct(t.tolist())
    monkeypatch.setattr(runs, "_junctions", lambda *a: np.empty((0, 2), np.int64))
    assert len(runs.search([t])[0]) < len(whole)


def test_long_periods():
    rng = np.random.default_rng(3)
    for p in (999, 4096, 5000):
        t = rng.integers(0, 10**6, 20_000)
        t[3000: 3000 + 2 * p + 7] = t[3000 + np.arange(2 * p + 7) % p]
        assert runs.search([t])[0].tolist() == [[3000, 2 * p + 7, p]]


def answer(i, t):
    """The contract's row of a document, its words rewritten first."""
    w = words(t)
    if i is not None and w and zlib.crc32(str(i).encode()) % 10 == 0:
        g, n = zlib.crc32(str(i).encode()) // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = sorted(direct(w), key=lambda r: (r[0], r[2]))
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (i, len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha("".join("%d,%d,%d\n" % r for r in found).encode()),
            sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_query(spark, docs):  # noqa: F811
    short = {i for i, t, *_ in docs if len(words(t)) < 700}
    got = queries.op11_periodic_runs(spark, SMALL).collect()
    assert len(got) == len(docs) and len(short) > 100
    assert Counter(tuple(r) for r in got if r["doc_id"] in short) == Counter(answer(i, t) for i, t, *_ in docs if i in short)


def test_odd_rows(spark, none):  # noqa: F811
    rows = ODD + [(k, "a b\nc " * k + "d", "en", "a") for k in range(40, 60)] + [(42, "x y " * 20, "en", "a")] * 3
    got = runs.periodic_runs(queries.rewritten(made(spark, rows)))
    sha = got.select("doc_id", F.size("runs").alias("n"), F.sha2("collapsed", 256).alias("h")).collect()
    small = [r for r in rows if r[0] != 5]
    assert Counter(tuple(r) for r in sha if r["doc_id"] != 5) == Counter((i, *[answer(i, t)[k] for k in (1, 7)]) for i, t, *_ in small)
    five = [r for r in runs.periodic_runs(made(spark, [r for r in rows if r[0] == 5])).collect()]
    assert [tuple(x) for x in five[0]["runs"]] == [(1, 6000, 2)] and five[0]["collapsed"] == "x" * 5000 + " long word"
    assert runs.periodic_runs(none).count() == 0
