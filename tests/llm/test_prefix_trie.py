"""The prefix trie against one built in memory."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ragtide.llm import prefix_trie, queries
from ragtide.sources.tables import table

from .test_llm import SMALL

TURNS = "conv_id long, turn long, role string, text string, pos int, k1 string, `block` int"


def by_conversation(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {c: [x[2:] for x in sorted(v)] for c, v in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def trie(convs):
    """The contract's rows."""
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[:d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in kids[p]) or 1
        saved[p] = sum(saved[q] for q in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(p)) for p, m in members.items())


def answer(spark, rows, again=rebuilt):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS).repartition(3)
    turns = prefix_trie.ordered(df)
    if again is rebuilt:
        turns, convs = queries.rebuilt(turns)
    else:
        convs = turns.select("conv_id").distinct()
    t = prefix_trie.Trie(turns, convs)
    got = t.nodes.join(prefix_trie.members_sha256(t.ends), prefix_trie.KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", F.coalesce("sha", F.sha2(F.lit(""), 256)))
    return Counter(tuple(r) for r in got.collect()), trie(again(by_conversation(rows)))


def test_query(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = Counter(tuple(r) for r in queries.op12_prefix_trie(spark, SMALL).collect())
    assert got == trie(rebuilt(by_conversation(rows))) and len(got) > 30


def test_odd_conversations(spark, monkeypatch):
    """Nulls, ties, repeated rows, one long conversation, many equal ones, absent bases, negative ids."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 8)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rng = random.Random(6)
    say = ["", None, "a", "b", "é é", "long " * 20]
    rows = [(c, rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", None, ""]), rng.choice(say)) for c in range(-7, 60) if c % 7 for _ in range(rng.randint(1, 12))]
    rows += [(100, k, "user", "x") for k in range(150)] + [(103, k, "user", "x") for k in range(90)]
    rows += [(200 + c, k, "user", f"copy {k}") for c in range(40) for k in range(3)]
    rows += [(None, 1, "user", "nobody's"), (300, 1, "user", "same"), (300, 1, "user", "same")]
    got, want = answer(spark, rows)
    assert got == want


def test_chains_and_hot_parents(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "HOT", 8)
    rng = random.Random(7)
    rows = [(c, k, "user", f"{rng.randrange(2)}") for c in range(30) for k in range(rng.randint(1, 9))]
    rows += [(c, 0, "user", "one first turn for all") for c in range(1000, 1200)] + [(c, 1, "user", str(c)) for c in range(1000, 1200)]
    rows += [(2000, k, "user", f"chain {k}") for k in range(300)]
    got, want = answer(spark, rows, again=lambda x: x)
    assert got == want


def test_empty(spark):
    assert answer(spark, []) == (Counter(), Counter())


@pytest.mark.parametrize("n", [1, 2, 40])
def test_subtree_totals(spark, n):
    rng = random.Random(n)
    parent = [None] + [rng.randrange(max(0, k - 3), k) for k in range(1, n)]
    kids = Counter(p for p in parent if p is not None)
    a = [(rng.randrange(9), rng.randrange(9)) for _ in range(n)]
    total = [list(x) for x in a]
    for k in range(n - 1, 0, -1):
        for j in (0, 1):
            total[parent[k]][j] += total[k][j]
    tree = spark.createDataFrame([(k, parent[k], kids[k], *a[k]) for k in range(n)], "nid long, pid long, kids long, a1 long, a2 long")
    assert {r["nid"]: [r["a1"], r["a2"]] for r in prefix_trie.subtree_totals(tree).collect()} == dict(enumerate(total))
