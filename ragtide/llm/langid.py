"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word's probability is the sum, by the forward algorithm, over all its
segmentations into pieces; a text's is the product over all its words.  All
sums are kept in logs, so a run of any characters has a finite score.  The
probabilities are fitted by expectation-maximisation over the same lattices.

Fitting reads a bounded sample of labelled rows: about ``SAMPLE_DOCS``
documents of each language, chosen by a hash of their id, and of their word
counts the ``TRAIN_WORDS`` highest.  Scoring reads every word of every text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
so is every text if there is nothing to learn from; a null language teaches
nothing; equal scores go to the language first by code point; a word of any
length is scored whole, over all its segmentations (a learned one is cut into
parts of ``LEARN_PART`` characters); repeated rows are scored alike; extra
columns are ignored, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import SPACE, automaton, lattice

SAMPLE_DOCS, TRAIN_WORDS, ROUNDS, SMOOTH = 500, 200_000, 4, 0.05
MAX_LANGUAGES = 1_000
LEARN_PART, UNKNOWN, MEMO, BATCH = 60, 1e-8, 500_000, 2_000
KEPT_WORD, PART, CELLS, BLOCK = 60, 2_000, 32_000, 4_096          # characters of a remembered word; words and words x positions at once; of one word
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def words_of(text: str) -> list[str]:
    ws = text.lower().split()
    return (SPACE + f" {SPACE}".join(ws)).split(" ") if ws else []


def learned_words(text: str) -> list[str]:
    return [w[i: i + LEARN_PART] for w in words_of(text) for i in range(0, len(w), LEARN_PART)]


def _by(at: np.ndarray, top: int) -> list[np.ndarray]:
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(top + 2))
    return [order[cuts[k]: cuts[k + 1]] for k in range(top + 1)]


def _add(a: np.ndarray, k: int, x: np.ndarray, w: np.ndarray) -> None:
    """Adds the sums of x by word (w, ascending) to position k of a; all in logs."""
    if not len(w):
        return
    first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    who = w[first]
    top = np.maximum(np.maximum.reduceat(x, first, axis=0), a[who, k])
    at = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(w))))
    a[who, k] = top + np.log(np.add.reduceat(np.exp(x - top[at]), first, axis=0) + np.exp(a[who, k] - top))


def log_forward(words: list[str], lat, logp: np.ndarray, head: np.ndarray | None = None) -> np.ndarray:
    """Logs of the forward sums (words x positions x languages), finite for any word; logp: pieces x languages.
    ``head``: the sums of the first positions, where these are known."""
    w, s, e, p = lat
    size = max(map(len, words))
    a = np.zeros((len(words), size + 1, logp.shape[1]))
    known = 1 if head is None else head.shape[1]
    if head is not None:
        a[:, :known] = head
    ends = _by(e, size)
    for k in range(known, size + 1):
        a[:, k] = a[:, k - 1] + math.log(UNKNOWN)
        m = ends[k]
        _add(a, k, a[w[m], s[m]] + logp[p[m]], w[m])
    return a


def log_total(word: str, path: str, logp: np.ndarray) -> np.ndarray:
    """The last of one word's ``log_forward`` sums, a block of it at a time: a block starts from the sums
    of as many positions before it as the longest piece is long, so no segmentation is lost."""
    reach = max(map(len, automaton(path)[1]))
    head, lo = np.zeros((1, 1, logp.shape[1])), 0
    for at in range(0, len(word), BLOCK):
        part = word[lo: at + BLOCK]
        a = log_forward([part], lattice([part], path), logp, head)
        nxt = max(0, at + BLOCK - reach)
        head, lo = a[:, nxt - lo:], nxt
    return a[0, -1]


def log_backward(words: list[str], lat, logp: np.ndarray) -> np.ndarray:
    w, s, e, p = lat
    size = max(map(len, words))
    b = np.full((len(words), size + 1, logp.shape[1]), -np.inf)
    lens = np.array([len(x) for x in words])
    b[np.arange(len(words)), lens] = 0.0
    starts = _by(s, size)
    for k in range(size - 1, -1, -1):
        inner = lens > k
        b[inner, k] = b[inner, k + 1] + math.log(UNKNOWN)
        m = starts[k]
        _add(b, k, b[w[m], e[m]] + logp[p[m]], w[m])
    return b


def forward(words: list[str], lat, prob: np.ndarray) -> np.ndarray:
    """The forward sums themselves; prob: pieces x languages.  They reach 0 on long words, ``log_forward`` does not."""
    with np.errstate(divide="ignore"):
        return np.exp(log_forward(words, lat, np.log(prob)))


def fit(counts: dict[str, dict[str, int]], path: str, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages, pieces x languages probabilities) from word counts of each language."""
    names = sorted(counts)
    v = len(automaton(path)[1])
    prob = np.full((v, len(names)), 1.0 / v)
    for lang, words in enumerate(names):
        rows = sorted(counts[words].items())
        parts = []
        for i in range(0, len(rows), BATCH):
            ws = [x for x, _ in rows[i: i + BATCH]]
            parts.append((ws, np.array([c for _, c in rows[i: i + BATCH]], float), lattice(ws, path)))
        for _ in range(rounds):
            got = np.zeros(v)
            col = np.log(prob[:, lang: lang + 1])
            for ws, n, lat in parts:
                a, b = log_forward(ws, lat, col)[..., 0], log_backward(ws, lat, col)[..., 0]
                z = a[np.arange(len(ws)), [len(x) for x in ws]]
                w, s, e, p = lat
                np.add.at(got, p, n[w] * np.exp(a[w, s] + col[p, 0] + b[w, e] - z[w]))
            prob[:, lang] = (got + SMOOTH) / (got + SMOOTH).sum()
    return names, prob


def sample(df: DataFrame, learn: Column, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, text) of about ``sample_docs`` rows a language, by a hash of the id."""
    spark = df.sparkSession
    known = df.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(n) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    share = spark.createDataFrame([(k, min(1.0, sample_docs / c)) for k, c in n.items()], "lang string, share double")
    u = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return known.join(F.broadcast(share), "lang").filter(u < F.col("share")).select("lang", "text")


def word_counts(rows: DataFrame, most: int = TRAIN_WORDS) -> dict[str, dict[str, int]]:
    """{language: {word: count}} of the ``most`` highest counts."""
    def part(batches):
        sums: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                sums.setdefault(lang, Counter()).update(learned_words(text))
        for lang, c in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()),
                                              pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

    top = (rows.mapInArrow(part, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "lang", "word").limit(most))
    out: dict[str, dict[str, int]] = {}
    for r in top.toLocalIterator():
        out.setdefault(r["lang"], {})[r["word"]] = r["n"]
    return out


class _Places(dict):
    """The place of every word, given out as it is first met."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        k = self[word] = len(self)
        return k


class Scorer:
    def __init__(self, names: list[str], prob: np.ndarray, path: str):
        self.names, self.logp, self.path = names, np.log(prob), path
        self.memo, self.logs = _Places(), np.empty((0, len(names)))     # the words' places; their logs by place

    def _learn(self, words: list[str]) -> None:
        """The logs of ``words``, which have the last places."""
        have = len(self.memo)
        if len(self.logs) < have:
            self.logs = np.concatenate([self.logs, np.empty((max(have, 2 * len(self.logs)) - len(self.logs), len(self.names)))])
        words = sorted(words, key=len)
        places = [self.memo[w] for w in words]
        at = 0
        while at < len(words) and len(words[at]) <= BLOCK:
            part = words[at: at + PART]
            while len(part) > 1 and len(part) * len(part[-1]) > CELLS:
                part = part[: len(part) // 2]
            a = log_forward(part, lattice(part, self.path), self.logp)
            self.logs[places[at: at + len(part)]] = a[np.arange(len(part)), [len(x) for x in part]]
            at += len(part)
        for k, w in zip(places[at:], words[at:]):
            self.logs[k] = log_total(w, self.path, self.logp)

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        langs, scores = [], []
        todo = []
        for t in texts:
            ws = [] if t is None or not self.names or not _LETTER.search(t) else words_of(t)
            todo.append(np.fromiter(map(self.memo.__getitem__, ws), np.int64, len(ws)))
        new, self.memo.new = self.memo.new, []
        if new:
            self._learn(new)
        for places in todo:
            if not len(places):
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            z = self.logs[places].sum(axis=0)
            k = int(np.argmax(z))
            langs.append(self.names[k])
            scores.append(float(1.0 / np.exp(z - z[k]).sum()))
        if any(len(w) > KEPT_WORD for w in new):                       # long words are not remembered: the others take the first of the new places
            old = len(self.memo) - len(new)
            kept = [w for w in new if len(w) <= KEPT_WORD]
            self.logs[old: old + len(kept)] = self.logs[[self.memo[w] for w in kept]]
            for w in new:
                del self.memo[w]
            self.memo.update(zip(kept, range(old, old + len(kept))))
        return langs, scores


def predict(df: DataFrame, names: list[str], prob: np.ndarray, path: str, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred and its probability among the languages, given the text alone."""
    model = df.sparkSession.sparkContext.broadcast((names, prob))     # vocabulary x languages numbers

    def part(batches):
        scorer = Scorer(*model.value, path)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                rows = batch.slice(i, 512)
                langs, scores = scorer.score(rows.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays([rows.column("__id"), rows.column("__held"), pa.array(langs, pa.string()),
                                                  pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    src = df.select(F.col("doc_id").cast("long").alias("__id"), held_out.alias("__held"), F.col("text").cast("string").alias("__text"))
    return src.mapInArrow(part, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(df: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Fit on the rows not held out, predict all rows."""
    df = df.select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    names, prob = fit(word_counts(sample(df, ~held, sample_docs)), path)
    return predict(df, names, prob, path, held)
