"""Periodic runs of words, by string synchronising sets.

A run is a stretch of a text's words with smallest period q and at least 2 q words
that no neighbouring word extends.  Many texts are laid one after another, parted by
symbols that occur once, and searched together in numpy:

* a window of 2^k words has a 64-bit name made from the names of its halves;
* at the scale t = 2^k, a position belongs to the synchronising set if the smallest
  name of the windows of t words that begin at it and the t positions after it is
  that of the first or the last one.  That depends on the next 2 t words alone, so it
  is the same for equal contexts.  Windows inside a highly periodic region (a
  run of period t / 3 at most) do not count;
* two positions of the set with equal contexts of 2 t words, 3 t to 6 t - 1 apart,
  propose their distance as a period.  Every run with a period in that range has such a pair,
  unless its unit is highly periodic itself: these come from two neighbouring highly periodic regions of one period, whose phases leave
  one proposal for every turn of the smaller period.  Periods below 6 are compared directly;
* a proposal is extended both ways by the windows' names; of the periods of one stretch the smallest stays.

Every document is one row of one batch, so nothing is shuffled; the names of a text of n words take
8 n log2(n) bytes.

Defined cases: a null, empty or blank text has no words and no runs, and collapses to an empty
text; words are compared byte by byte; rows with equal ids or texts are rows of
their own; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import U64, groups, mix, string_buffers

MIN_WORDS = 12
DIRECT = 6                        # smaller periods are compared directly
BATCH = 1 << 20                   # bytes of texts searched together
_NONE = U64(2**64 - 1)


class Names:
    """Names of all windows of 2^k words.  ``ends[k]``: the texts before this place are the ones of 2^k words or more."""

    def __init__(self, symbols: np.ndarray, reach: list[int]):
        self.level = [mix(symbols.astype(np.int64).view(U64) + U64(0x9E3779B97F4A7C15))]
        for k in range(1, len(reach)):
            h, half = self.level[-1][: reach[k]], 1 << (k - 1)
            if len(h) <= half:
                break
            self.level.append(mix(h[:-half] * U64(0xD6E8FEB86659FD93) + mix(h[half:] + U64(k))))

    def same(self, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        """Whether the n words at a and at b are equal (b >= a)."""
        k = n.bit_length() - 1
        h, more = self.level[k], n - (1 << k)
        return (h[a] == h[b]) & (h[a + more] == h[b + more])

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and from b on are equal (a < b)."""
        b0, a, b = b, a.copy(), b.copy()
        for k in range(len(self.level) - 1, -1, -1):
            h = self.level[k]
            ok = b < len(h)
            ok[ok] = h[a[ok]] == h[b[ok]]
            a[ok] += 1 << k
            b[ok] += 1 << k
        return b - b0

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a and before b are equal (a < b)."""
        a0, a, b = a, a.copy(), b.copy()
        for k in range(len(self.level) - 1, -1, -1):
            h, step = self.level[k], 1 << k
            ok = (a >= step) & (b - step < len(h))
            ok[ok] = h[a[ok] - step] == h[b[ok] - step]
            a[ok] -= step
            b[ok] -= step
        return a0 - a


def _direct(t: np.ndarray, p: int, least: int) -> np.ndarray:
    """(start, end, p) of the stretches of period p, of 2 p words and ``least`` or more."""
    if len(t) <= p:
        return np.empty((0, 3), np.int64)
    same = np.concatenate([[False], t[p:] == t[:-p], [False]])
    turn = np.flatnonzero(same[1:] != same[:-1])
    s, e = turn[::2], turn[1::2] + p
    keep = e - s >= max(2 * p, least)
    return np.stack([s[keep], e[keep], np.full(keep.sum(), p)], 1).astype(np.int64)


def _smallest(x: np.ndarray, m: int) -> np.ndarray:
    """Minimum of every m neighbouring entries."""
    s = 1
    while 2 * s <= m:
        x = np.minimum(x[:-s], x[s:])
        s *= 2
    return np.minimum(x[: len(x) - (m - s)], x[m - s:]) if m > s else x


def _pairs(names: Names, k: int, end: int, found: np.ndarray) -> np.ndarray:
    """(position, period) of the equal contexts of the synchronising set at the scale 2^k."""
    t = 1 << k
    own = names.level[k][: max(0, end - t + 1)].copy()
    if len(own) <= t or k + 1 >= len(names.level):
        return np.empty((0, 2), np.int64)
    quiet = found[(3 * found[:, 2] <= t) & (found[:, 1] - found[:, 0] >= t) & (found[:, 0] < len(own))]
    if len(quiet):
        mark = np.zeros(len(own) + 1, np.int64)
        np.add.at(mark, quiet[:, 0], 1)
        np.add.at(mark, np.minimum(quiet[:, 1] - t + 1, len(own)), -1)
        own[np.cumsum(mark[:-1]) > 0] = _NONE
    least = _smallest(own, t + 1)
    at = np.flatnonzero((least != _NONE) & ((own[: len(least)] == least) | (own[t:] == least)))
    context = names.level[k + 1]
    at = at[at < len(context)]
    order = np.argsort(context[at], kind="stable")
    at = at[order]
    c = context[at]
    out, lag = [], 1
    here = np.arange(len(at))
    while len(here):
        here = here[here + lag < len(at)]
        gap = at[here + lag] - at[here]
        near = (c[here + lag] == c[here]) & (gap < 6 * t)
        here, gap = here[near], gap[near]               # a farther one of the same context is farther away
        far = gap >= 3 * t
        out.append(np.stack([at[here[far]], gap[far]], 1))
        lag += 1
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def _junctions(names: Names, k: int, found: np.ndarray) -> np.ndarray:
    """(position, period), 3 t to 6 t - 1, from neighbouring highly periodic regions of one period."""
    t = 1 << k
    r = found[(3 * found[:, 2] <= t) & (found[:, 1] - found[:, 0] >= 3 * t)]
    r = r[np.lexsort((r[:, 0], r[:, 2]))]
    out = []
    for i in np.flatnonzero((r[1:, 2] == r[:-1, 2]) & (r[1:, 0] <= r[:-1, 1])):
        (a, y, d), (x, z, _) = r[i], r[i + 1]
        at = np.arange(max(a, y - 2 * d), y - d)        # one turn of the first region
        hit = at[names.same(at, np.full(len(at), x), int(d))]
        if len(hit):
            p = (x - hit[0]) % d + d * np.arange(0, 6 * t // d + 1)
            p = p[(p >= 3 * t) & (p < 6 * t) & (p <= min(y - a, z - x))]
            out.append(np.stack([np.maximum(a, x - p), p], 1))
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def _one_period(found: np.ndarray) -> np.ndarray:
    """Of the periods of one stretch, the smallest; by start, then end."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    return found[np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(1)])] if len(found) else found


def search(texts: list[np.ndarray], least: int = MIN_WORDS) -> list[np.ndarray]:
    """For every text (an array of numbers that name its words), its runs of ``least`` words or more: rows (start, length, period) by start, then period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    flat = np.empty(int((sizes + 1).sum()), np.int64)
    for j, i in enumerate(order):
        flat[starts[j]: starts[j] + sizes[j]] = texts[i]
        flat[starts[j] + sizes[j]] = -1 - j              # occurs once: no run crosses it
    longest = int(sizes[0]) if len(sizes) else 0

    def reach(n: int) -> int:
        """Where the texts of n words or more end."""
        k = int(np.searchsorted(-sizes, -n, "right"))
        return int(starts[k - 1] + sizes[k - 1]) + 1 if k else 0

    kept = min(4, least)                                 # regions for the larger scales; shorter runs play no part there
    found = _one_period(np.concatenate([_direct(flat, p, kept) for p in range(1, DIRECT)]))
    names = Names(flat, [reach(1 << k) for k in range(max(longest, 1).bit_length())])
    k = 1
    while 6 << k <= longest:
        made = np.concatenate([_pairs(names, k, reach(6 << k), found), _junctions(names, k, found)])
        if len(made):
            i, p = made[:, 0], made[:, 1]
            s = i - names.behind(i, i + p)
            e = i + p + names.ahead(i, i + p)
            new = np.stack([s, e, p], 1)[e - s >= 2 * p]
            found = _one_period(np.concatenate([found, new]))
        k += 1
    found = found[found[:, 1] - found[:, 0] >= least]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    text = np.searchsorted(starts, found[:, 0], "right") - 1
    out: list = [None] * len(texts)
    for j, i in enumerate(order):
        lo, hi = np.searchsorted(text, [j, j + 1])
        r = found[lo:hi]
        out[i] = np.stack([r[:, 0] - starts[j], r[:, 1] - r[:, 0], r[:, 2]], 1)
    return out


def repeated(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, runs[:, 0] + runs[:, 2], 1)
    np.add.at(mark, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(mark[:-1]) > 0


RUNS_SCHEMA = "doc_id long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def periodic_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, runs, collapsed) of every row: all runs of ``least`` words or more by start, then
    period, and the text's words without those that repeat an earlier period of a run, joined by one space."""
    run_type = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def part(batches):
        for batch in batches:
            buf, offs = string_buffers(batch.column("__text"))
            for i, j in groups(offs, BATCH):
                number: dict[bytes, int] = defaultdict(count().__next__)
                words = [buf[offs[k]: offs[k + 1]].tobytes().split() for k in range(i, j)]
                found = search([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in words], least)
                short = [b" ".join(w) if not len(r) else b" ".join(x for x, gone in zip(w, repeated(len(w), r).tolist()) if not gone)
                         for w, r in zip(words, found)]
                rows = np.concatenate(found)
                ends = np.cumsum([0, *map(len, found)])
                runs = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], fields=list(run_type))
                yield pa.RecordBatch.from_arrays([batch.column("__id").slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs),
                                                  pa.array(short, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    src = df.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("string").alias("__text"))
    return src.mapInArrow(part, RUNS_SCHEMA)
