"""Quality rules: repetition and length base rules, and the divergence of a
document's character-class and common-word histograms from language references.

A language's reference is the pooled histogram of its documents that pass the
base rules; a language with fewer than ``MIN_REFERENCE_DOCS`` of them, or fewer
than ``MIN_REFERENCE_WORDS`` words in them, has none.  Words are counted in the
cells of ``COMMON`` and, for a language not listed there, in cells of its own:
its ``COMMON_WORDS`` most frequent words, as far as each makes ``COMMON_SHARE``
of its words, from exact counts over those documents.

A document is compared, by Jensen-Shannon distance (base 2, 0 to 1), with every
language's reference.  Both distances are those to the nearest language: the one
whose larger distance, each as a part of its limit, is smallest; so a document
passes only if it passes by both histograms of one language.
Guards: a document under ``min_words`` words is not judged by divergence, so
its verdict is the base rules' alone; and a short histogram strays from its
reference by chance, by about 1/sqrt(words), so the word limit is
``max_word_js + WORD_JS_SLACK / sqrt(n_words)``.

Defined cases: null or empty text has no words and fails the base rules; a null
``lang`` gives nothing to the references and is judged by the nearest; with no
reference at all (empty table, no language), or for a row whose own language has
none, only the base rules judge; a language without frequent words (unspaced
script) has only the listed cells; repeated rows are judged alike; columns
beside ``doc_id``, ``text`` and ``lang`` are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .text import LOWER, WHITE, groups, string_buffers, windows, word_hashes

MIN_WORDS_BASE, REPEAT_PCT, WINDOW = 20, 30, 8
MIN_WORDS, MAX_CHAR_JS, MAX_WORD_JS, WORD_JS_SLACK = 50, 0.25, 0.24, 1.6
COMMON_WORDS, COMMON_SHARE, SEGMENT = 36, 0.002, 1 << 22
MIN_REFERENCE_DOCS, MIN_REFERENCE_WORDS = 10, 2_000

# --- fixed values: frequent function words, by language -----------------------
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son ou aux",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si",
}
SYMBOLS = b"#*$%&|<>"
# ------------------------------------------------------------------------------

WORDS = sorted({w for ws in COMMON.values() for w in ws.split()})
N_WORD_CELLS = len(WORDS) + 1            # the last cell: every other word
CHAR_CELLS = 8                           # lower, upper, non-ASCII, digit, space, line end, sentence mark, other
N_CELLS = CHAR_CELLS + N_WORD_CELLS

_CLASS = np.full(256, 7, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[128:], _CLASS[48:58] = 0, 1, 2, 3
_CLASS[[32, 9, 11, 12]], _CLASS[[10, 13]] = 4, 5
_CLASS[list(b".,;:!?'\"()-")] = 6
_COUNTS = np.ones(256, bool)
_COUNTS[128:192] = False                 # continuation bytes belong to the character before
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[97:123] = _NOT_LETTER[65:91] = _NOT_LETTER[128:] = False


def _word_table() -> tuple[np.ndarray, np.ndarray]:
    buf, offs = string_buffers(pa.array(WORDS, pa.string()))
    h, _ = word_hashes(buf, offs, _NOT_LETTER)
    order = np.argsort(h)
    return h[order], order


_NONE = np.empty(0, np.uint64)


def _per_text(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(mask)])
    return c[offs[1:]] - c[offs[:-1]]


def _char_counts(buf: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    keep = _COUNTS[buf] & (doc >= 0)
    return np.bincount(doc[keep] * CHAR_CELLS + _CLASS[buf[keep]], minlength=n * CHAR_CELLS).reshape(n, CHAR_CELLS)


def _cells(h: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Each word's cell; the one after the table's cells is every other word."""
    keys, order = table
    if not len(keys):
        return np.zeros(len(h), np.int64)
    pos = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[pos] == h, order[pos], len(keys))


def histograms(buf: np.ndarray, offs: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(texts x cells) counts: character classes, then the table's words and the rest."""
    n, cells = len(offs) - 1, len(table[0]) + 1
    chars = _char_counts(buf, np.repeat(np.arange(n), np.diff(offs)), n)
    h, at = word_hashes(LOWER[buf], offs, _NOT_LETTER)
    doc = np.repeat(np.arange(n), np.diff(at))
    words = np.bincount(doc * cells + _cells(h, table), minlength=n * cells).reshape(n, cells)
    return np.concatenate([chars, words], axis=1)


def _texts(batch: pa.RecordBatch, name: str, most: int = 1 << 15) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, offs = string_buffers(batch.column(name))
    for i, j in groups(offs):
        for k in range(i, j, most):
            m = min(k + most, j)
            yield k, m, buf[offs[k]: offs[m]], offs[k: m + 1] - offs[k]


def _pieces(buf: np.ndarray, limit: int = 1 << 22) -> Iterator[np.ndarray]:
    """A very long text in parts cut at spaces, for histograms."""
    at = 0
    while at < len(buf):
        to = min(at + limit, len(buf))
        cut = np.flatnonzero(buf[to: to + limit] == 32)
        to = to + int(cut[0]) if to < len(buf) and len(cut) else (to if to == len(buf) else min(to + limit, len(buf)))
        yield buf[at:to]
        at = to


def _hist(b: np.ndarray, o: np.ndarray, table) -> np.ndarray:
    if len(o) == 2 and o[1] > 1 << 22:
        return sum(histograms(p, np.array([0, len(p)]), table) for p in _pieces(b))
    return histograms(b, o, table)


@dataclass
class References:
    """Per language: counts of the character classes and of (listed words, own words, the rest)."""
    names: list[str]
    chars: list[np.ndarray]
    own: list[np.ndarray]                # hashes of each language's own words
    words: list[np.ndarray]


def _good(b: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Which texts pass the base rules."""
    h, at = word_hashes(b, o)
    return ~_base_failed(np.diff(at), np.array([_repeated(h[at[k]: at[k + 1]], WINDOW) for k in range(len(o) - 1)], np.int64))


def _labelled(batch: pa.RecordBatch) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(languages, each text's place among them, bytes, offsets); -1 for a text that teaches nothing."""
    langs = batch.column("lang").to_pylist()
    for i, j, b, o in _texts(batch, "text"):
        good, at = _good(b, o), {}
        owner = np.array([at.setdefault(x, len(at)) if ok and x is not None else -1 for x, ok in zip(langs[i:j], good)], np.int64)
        if at:
            yield list(at), owner, b, o


def _candidates(rows: DataFrame) -> dict[str, np.ndarray]:
    """{language: hashes} of all words that can make ``COMMON_SHARE`` of an unlisted language.

    Tasks count in segments and give a segment's words above a quarter of that
    share.  Where a word was not given it makes less than that, so what was
    given bounds its whole count from above, and no common word is missed."""
    low = COMMON_SHARE / 4

    def flush(seen):
        for name, (docs, parts) in seen.items():
            h = np.concatenate(parts)
            u, c = np.unique(h, return_counts=True)
            hit = c >= low * len(h)
            u, c = u[hit].view(np.int64), c[hit]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(u) + 1), pa.string()), pa.array([None, *u.tolist()], pa.int64()),
                 pa.array([docs, *c.tolist()], pa.int64()), pa.array([len(h)] * (len(u) + 1), pa.int64())], names=["lang", "h", "n", "of"])
        seen.clear()

    def part(batches):
        seen, size = {}, 0
        for batch in batches:
            for names, owner, b, o in _labelled(batch):
                h, at = word_hashes(LOWER[b], o, _NOT_LETTER)
                for k in np.flatnonzero(owner >= 0):
                    own = seen.setdefault(names[owner[k]], [0, []])
                    own[0] += 1
                    own[1].append(h[at[k]: at[k + 1]].copy())
                    size += 64 + int(at[k + 1] - at[k])
                if size > SEGMENT:
                    yield from flush(seen)
                    size = 0
        yield from flush(seen)

    got = (rows.filter(~F.col("lang").isin(*COMMON)).mapInArrow(part, "lang string, h long, n long, of long")
           .groupBy("lang", "h").agg(F.sum("n").alias("n"), F.sum("of").alias("of")))
    got = written(got, "common-words")
    total = got.filter(F.col("h").isNull() & (F.col("n") >= MIN_REFERENCE_DOCS) & (F.col("of") >= MIN_REFERENCE_WORDS))
    got = (got.filter(F.col("h").isNotNull()).join(total.select("lang", F.col("of").alias("all")), "lang")
           .filter(F.col("n") + low * (F.col("all") - F.col("of")) >= COMMON_SHARE * F.col("all")))
    out: dict[str, list[int]] = {}
    for r in got.select("lang", "h").toLocalIterator():      # a few hundred words a language at most
        out.setdefault(r["lang"], []).append(r["h"])
    listed = _word_table()[0]
    return {k: np.setdiff1d(np.array(v, np.int64).view(np.uint64), listed) for k, v in out.items()}


def language_references(df: DataFrame, text: str = "text", lang: str = "lang") -> References:
    """The languages' references, from all rows with a language that pass the base rules."""
    rows = df.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang IS NOT NULL")
    own = _candidates(rows)

    def flush(sums):
        for name, v in sums.items():
            cells = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells), pa.string()), pa.array(cells, pa.int32()),
                                              pa.array(v[cells], pa.int64())], names=["lang", "cell", "n"])
        sums.clear()

    def pooled(names, owner, b, o, table):
        """Counts per language: characters, listed words and the rest, own candidates."""
        n = len(names)
        chars = _char_counts(b, np.repeat(owner, np.diff(o)), n)
        h, at = word_hashes(LOWER[b], o, _NOT_LETTER)
        who = np.repeat(owner, np.diff(at))
        h, who = h[who >= 0], who[who >= 0]
        words = np.bincount(who * N_WORD_CELLS + _cells(h, table), minlength=n * N_WORD_CELLS).reshape(n, N_WORD_CELLS)
        for k, name in enumerate(names):
            cand = own.get(name, _NONE)
            mine = np.bincount(_cells(h[who == k], (cand, np.arange(len(cand)))), minlength=len(cand) + 1)[:-1] if len(cand) else ()
            yield name, np.concatenate([chars[k], words[k], mine]).astype(np.int64)

    def part(batches):
        table, sums = _word_table(), {}
        for batch in batches:
            for names, owner, b, o in _labelled(batch):
                for name, n in zip(names, np.bincount(owner[owner >= 0])):
                    sums.setdefault(name, np.zeros(N_CELLS + len(own.get(name, _NONE)) + 1, np.int64))[-1] += n
                long = len(o) == 2 and o[1] > 1 << 22
                for x, y in (((x, np.array([0, len(x)])) for x in _pieces(b)) if long else [(b, o)]):
                    for name, v in pooled(names, owner, x, y, table):
                        sums[name][:-1] += v
                if len(sums) > 10_000:
                    yield from flush(sums)
        yield from flush(sums)

    got = (rows.mapInArrow(part, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
           .groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("v")))
    out = References([], [], [], [])
    for r in got.filter(F.size("v") > 0).orderBy("lang").toLocalIterator():
        cand = own.get(r["lang"], _NONE)
        v = np.zeros(N_CELLS + len(cand) + 1, np.int64)
        v[list(r["v"])] = list(r["v"].values())
        chars, words, mine, docs = v[:CHAR_CELLS], v[CHAR_CELLS: N_CELLS], v[N_CELLS: -1], v[-1]
        if docs < MIN_REFERENCE_DOCS or words.sum() < MIN_REFERENCE_WORDS:
            continue
        top = np.lexsort((cand, -mine))[:COMMON_WORDS]
        top = top[mine[top] >= COMMON_SHARE * words.sum()]
        out.names.append(r["lang"])
        out.chars.append(chars)
        out.own.append(cand[top])
        out.words.append(np.concatenate([words[:-1], mine[top], [words[-1] - mine[top].sum()]]))
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of p to q; rows of counts."""
    ps, qs = p.sum(-1, keepdims=True), q.sum(-1, keepdims=True)
    p, q = p / np.maximum(ps, 1), q / np.maximum(qs, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def _repeated(h: np.ndarray, k: int) -> int:
    """Words inside k-word windows that occur twice or more."""
    w = windows(h, k)
    if len(w) < 2:
        return 0
    _, inv, n = np.unique(w, return_inverse=True, return_counts=True)
    if len(n) == len(w):
        return 0
    hit = np.concatenate([(n[inv] > 1).astype(np.int64), np.zeros(k, np.int64)])
    edge = hit.copy()
    edge[k:] -= hit[:-k]
    return int((np.cumsum(edge)[: len(h)] > 0).sum())


def _base_failed(n_words: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS_BASE) | (100 * repeated > REPEAT_PCT * n_words)


def _dup_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else ()
    return len(lines) - len(set(lines))


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, char_js double, word_js double, nearest_lang string")


def judge(df: DataFrame, refs: References, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          min_words: int = MIN_WORDS, max_char_js: float = MAX_CHAR_JS, max_word_js: float = MAX_WORD_JS,
          extra: list[str] | None = None) -> DataFrame:
    """One row per document: the base counts, the distances to the nearest
    reference (``refs`` is carried with the function) and the verdict.
    ``extra`` columns of ``df`` are carried along."""
    extra = extra or []
    names = refs.names
    typ = {f.name: f for f in df.schema.fields}
    at_text = f"__x{extra.index(text)}" if text in extra else "__text"      # a text is sent to the workers once

    def part(batches):
        keys, order = _word_table()
        more = np.unique(np.concatenate([_NONE, *refs.own]))
        at = np.argsort(both := np.concatenate([keys, more]))
        table = both[at], np.concatenate([order, len(keys) + np.arange(len(more))])[at]
        own = [len(keys) + np.searchsorted(more, x) for x in refs.own]
        for batch in batches:
            for i, j, b, o in _texts(batch, at_text, max(1, (1 << 22) // len(both))):
                yield score(batch.slice(i, j - i), b, o, table, own)

    def score(rows, b, o, table, own):
        n = len(o) - 1
        h, at = word_hashes(b, o)
        n_words = np.diff(at)
        word_chars = _per_text(_COUNTS[b] & ~WHITE[b], o)
        n_symbols = _per_text(_SYMBOL[b], o)
        dup = np.array([_dup_lines(b[o[k]: o[k + 1]].tobytes()) for k in range(n)], np.int64)
        rep = np.array([_repeated(h[at[k]: at[k + 1]], WINDOW) for k in range(n)], np.int64)
        failed = _base_failed(n_words, rep)
        hist = _hist(b, o, table)
        chars, words = hist[:, :CHAR_CELLS], hist[:, CHAR_CELLS:]
        listed, total = words[:, :len(WORDS)], words.sum(axis=1, keepdims=True)
        limit = max_word_js + WORD_JS_SLACK / np.sqrt(np.maximum(n_words, 1))
        cj, wj, near, best = np.full(n, np.nan), np.full(n, np.nan), np.full(n, None), np.full(n, np.inf)
        for k, name in enumerate(names):
            mine = np.concatenate([listed, words[:, own[k]]], axis=1)
            c = js_distance(chars, refs.chars[k])
            w = js_distance(np.concatenate([mine, total - mine.sum(axis=1, keepdims=True)], axis=1), refs.words[k])
            far = np.maximum(c / max_char_js, w / limit)
            hit = far < best
            best, near = np.where(hit, far, best), np.where(hit, name, near)
            cj, wj = np.where(hit, c, cj), np.where(hit, w, wj)
        known = np.array([x is None or x in names for x in rows.column("__lang").to_pylist()], bool)
        judged = (n_words >= min_words) & known & (len(names) > 0)
        with np.errstate(invalid="ignore"):
            kept = ~failed & ~(judged & ((cj > max_char_js) | (wj > limit)))
        out = [rows.column("__id"), *(pa.array(x.astype(np.int64)) for x in (n_words, word_chars, n_symbols, dup, rep)),
               pa.array(failed), pa.array(kept), pa.array(cj, from_pandas=True), pa.array(wj, from_pandas=True),
               pa.array(near.tolist(), pa.string())]
        return pa.RecordBatch.from_arrays(out + [rows.column(f"__x{k}") for k in range(len(extra))],
                                          names=[*(x.split()[0] for x in SCHEMA.split(", ")), *(f"__x{k}" for k in range(len(extra)))])

    src = df.select(F.col(doc_id).cast("long").alias("__id"), *([] if text in extra else [F.col(text).cast("string").alias("__text")]),
                    F.col(lang).cast("string").alias("__lang"),
                    *(F.col(f"`{c}`").alias(f"__x{k}") for k, c in enumerate(extra)))
    schema = SCHEMA + "".join(f", __x{k} {typ[c].dataType.simpleString()}" for k, c in enumerate(extra))
    return src.mapInArrow(part, schema)


def quality(df: DataFrame, **kw) -> DataFrame:
    """References over all rows, then a verdict for every row."""
    return judge(df, language_references(df), **kw)


def keep_good(df: DataFrame) -> DataFrame:
    """The rows of a documents frame that pass, with their columns unchanged."""
    cols = df.columns
    out = judge(df, language_references(df), extra=cols).filter("kept")
    return out.select(*(F.col(f"__x{k}").alias(c) for k, c in enumerate(cols)))
