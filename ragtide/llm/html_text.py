"""Main text of HTML pages by a recurrent block labeller.

A page is a sequence of leaf blocks.  Each block is a vector: its tag path
(tags with their class, id and role words, hashed), its words (hashed) and a few
numbers.  A bidirectional LSTM in numpy reads the whole sequence and says of every block
whether it is main text, so a block is judged by the whole document around it.

The network is trained here, at each run, on ``PAGES`` made pages of random
layouts whose labels are known, filled with words of about ``SAMPLE`` pages of the
table (a hash of their id chooses them; ``SAMPLE_WORDS`` words at most).

Defined cases: a null or empty page has an empty text; markup that never closes
runs to the end of the page; a page with no block judged main has an empty text; blocks
equal to others stay; very long pages are labelled whole; repeated rows are
treated alike; an empty table gives no rows; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import blocks, made_page
from .text import LOWER, U64, groups, string_buffers, word_hashes

PATH_CELLS, WORD_CELLS, NUMBERS, HIDDEN = 96, 32, 6, 24
PAGES, EPOCHS, BATCH, RATE, SEED = 700, 6, 32, 0.01, 3
SAMPLE, SAMPLE_WORDS = 200, 20_000
WIDTH = PATH_CELLS + WORD_CELLS + NUMBERS

_PATHS: dict[tuple, np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = _PATHS.get(path)
    if v is None:
        v = np.zeros(PATH_CELLS, np.float32)
        for k, entry in enumerate(path):
            tag, *words = entry.split()
            v[zlib.crc32(tag.encode()) % PATH_CELLS] += 1
            for w in words:
                v[zlib.crc32(b"." + w.encode()) % PATH_CELLS] += 1
        if path:
            v[zlib.crc32(b"<" + path[-1].split()[0].encode()) % PATH_CELLS] += 1
        v = np.minimum(v, 2)
        if len(_PATHS) > 50_000:
            _PATHS.clear()
        _PATHS[path] = v
    return v


def vectors(pages: list[list[tuple[tuple[str, ...], str, float]]]) -> list[np.ndarray]:
    """(blocks x WIDTH) inputs of each page."""
    flat = [b for page in pages for b in page]
    x = np.zeros((len(flat), WIDTH), np.float32)
    if not flat:
        return [x] * len(pages)
    x[:, :PATH_CELLS] = [_path_vector(b[0]) for b in flat]
    buf, offs = string_buffers(pa.array([b[1] for b in flat], pa.string()))
    n = np.zeros(len(flat), np.int64)
    for i, j in groups(offs):
        h, at = word_hashes(LOWER[buf[offs[i]: offs[j]]], offs[i: j + 1] - offs[i])
        n[i:j] = np.diff(at)
        cell = np.repeat(np.arange(j - i), n[i:j]) * WORD_CELLS + (h % U64(WORD_CELLS)).astype(np.int64)
        counts = np.bincount(cell, minlength=(j - i) * WORD_CELLS).reshape(j - i, WORD_CELLS)
        x[i:j, PATH_CELLS: PATH_CELLS + WORD_CELLS] = 0.3 * np.log1p(counts)
    first = np.cumsum([0, *(len(p) for p in pages)])
    x[:, WIDTH - 6] = np.log1p(n) / 4
    x[:, WIDTH - 5] = [b[2] for b in flat]
    x[:, WIDTH - 4] = [b[1][-1] in ".!?:;\"" for b in flat]
    x[:, WIDTH - 3] = [min(len(b[0]), 10) / 10 for b in flat]
    x[:, WIDTH - 2] = np.array([b[1].count(",") for b in flat]) / n
    x[first[:-1][first[:-1] < len(flat)], WIDTH - 1] = 1
    return [x[s:e] for s, e in zip(first[:-1], first[1:])]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * z) + 1)


def init(seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {}
    for d in "fb":
        w[f"x{d}"] = rng.normal(size=(WIDTH, 4 * HIDDEN)) / math.sqrt(WIDTH)
        w[f"h{d}"] = rng.normal(size=(HIDDEN, 4 * HIDDEN)) / math.sqrt(HIDDEN)
        w[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    w["o"], w["p"] = rng.normal(size=2 * HIDDEN) / math.sqrt(2 * HIDDEN), np.zeros(1)
    return w


def _run(w, x, mask, d, keep=False):
    """One direction over (pages x steps x WIDTH); steps outside a page leave the state alone."""
    n, t, _ = x.shape
    h, c = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
    out, tape = np.zeros((n, t, HIDDEN), x.dtype), []
    z0 = x @ w[f"x{d}"] + w[f"c{d}"]
    for k in (range(t) if d == "f" else range(t - 1, -1, -1)):
        z = z0[:, k] + h @ w[f"h{d}"]
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN: 2 * HIDDEN], gates[:, 2 * HIDDEN:]
        g = np.tanh(z[:, 3 * HIDDEN:])
        m = mask[:, k: k + 1]
        c2 = m * (f * c + i * g) + (1 - m) * c
        tc = np.tanh(c2)
        h2 = m * (o * tc) + (1 - m) * h
        if keep:
            tape.append((k, h, c, i, f, o, g, tc, m))
        h, c = h2, c2
        out[:, k] = h
    return out, tape


def probabilities(w, x, mask) -> np.ndarray:
    both = np.concatenate([_run(w, x, mask, "f")[0], _run(w, x, mask, "b")[0]], axis=2)
    return _sigmoid(both @ w["o"] + w["p"])


def gradients(w, x, mask, y):
    """Gradient of the mean cross-entropy over all blocks."""
    runs = {d: _run(w, x, mask, d, True) for d in "fb"}
    both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
    dz = (_sigmoid(both @ w["o"] + w["p"]) - y) * mask / mask.sum()
    grad = {"o": np.einsum("nt,nth->h", dz, both), "p": dz.sum(keepdims=True).ravel()}
    back = dz[..., None] * w["o"]
    for d, part in (("f", back[..., :HIDDEN]), ("b", back[..., HIDDEN:])):
        dzs = np.zeros((*x.shape[:2], 4 * HIDDEN))
        gh = np.zeros_like(w[f"h{d}"])
        dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
        for k, h, c, i, f, o, g, tc, m in reversed(runs[d][1]):
            dh = dh + part[:, k]
            dn, hold = dh * m, dh * (1 - m)
            dcn = dc * m + dn * o * (1 - tc**2)
            z = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f), dn * tc * o * (1 - o), dcn * i * (1 - g**2)], axis=1)
            dzs[:, k] = z
            gh += h.T @ z
            dh = hold + z @ w[f"h{d}"].T
            dc = dc * (1 - m) + dcn * f
        grad[f"x{d}"], grad[f"h{d}"], grad[f"c{d}"] = np.einsum("ntw,ntz->wz", x, dzs, optimize=True), gh, dzs.sum(axis=(0, 1))
    return grad


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(p) for p in pages)
    x, mask = np.zeros((len(pages), t, WIDTH), np.float32), np.zeros((len(pages), t), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, 1
    return x, mask


def train(words: list[str], pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights fitted by Adam on made pages filled with ``words``."""
    rng = random.Random(seed)
    data = []
    while len(data) < pages:
        page, labels = made_page(rng, words)
        got = blocks(page)
        if len(got) == len(labels) and got:
            data.append((vectors([got])[0], np.array(labels, float)))
    w = init(seed)
    m1, m2, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(epochs):
        order = list(range(len(data)))
        rng.shuffle(order)
        order.sort(key=lambda k: len(data[k][0]) // 16)
        batches = [order[k: k + BATCH] for k in range(0, len(order), BATCH)]
        rng.shuffle(batches)
        for b in batches:
            x, mask = padded([data[k][0] for k in b])
            y = np.zeros_like(mask)
            for r, k in enumerate(b):
                y[r, : len(data[k][1])] = data[k][1]
            step += 1
            rate = RATE * (1 if epoch < epochs - 2 else 0.3)
            for k, g in gradients(w, x, mask, y).items():
                g = np.clip(g, -1, 1)
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return w


def label(w, pages: list[list]) -> list[np.ndarray]:
    """Boolean labels of each page's blocks; pages are batched by length."""
    out: list = [np.zeros(0, bool)] * len(pages)
    full = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
    while full:
        take = max(1, min(64, 20_000 // len(pages[full[0]])))
        some, full = full[:take], full[take:]
        x, mask = padded(vectors([pages[k] for k in some]))
        p = probabilities(w, x, mask)
        for r, k in enumerate(some):
            out[k] = p[r, : len(pages[k])] > 0.5
    return out


def extract(w, page: str | None) -> str:
    got = blocks(page or "")
    return "\n".join(b[1] for b, keep in zip(got, label(w, [got])[0]) if keep)


def sample_words(df: DataFrame, page_id: str, html: str) -> list[str]:
    """Words of about ``SAMPLE`` pages chosen by a hash of their id."""
    n = df.count()
    share = min(1.0, SAMPLE / max(n, 1))
    u = F.pmod(F.xxhash64(F.col(page_id), F.lit(9)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    words = F.split(F.regexp_replace(F.col(html).cast("string"), r"<[^>]*>|&[a-z]+;", " "), r"\s+")
    rows = (df.filter((u < share) & F.col(html).isNotNull()).select(F.explode(words).alias("w")).filter("length(w) between 1 and 30")
            .groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(SAMPLE_WORDS).collect())
    rows = [r["w"] for r in rows if "<" not in r["w"] and ">" not in r["w"] and "&" not in r["w"]]
    return rows or ["word"]


def main_text(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars and the numbers of blocks kept and seen."""
    model = df.sparkSession.sparkContext.broadcast(
        {k: v.astype(np.float32) for k, v in train(sample_words(df, page_id, html)).items()})     # some 40,000 numbers

    def part(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                got = [blocks(p or "") for p in rows.column("__html").to_pylist()]
                keep = label(model.value, got)
                texts = ["\n".join(b[1] for b, k in zip(p, ks) if k) for p, ks in zip(got, keep)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("__id"), rows.column("__url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([int(k.sum()) for k in keep], pa.int64()), pa.array([len(p) for p in got], pa.int64())],
                    names=["page_id", "url", "text", "n_chars", "n_kept", "n_blocks"])

    src = df.select(F.col(page_id).cast("long").alias("__id"), F.col(url).cast("string").alias("__url"), F.col(html).cast("string").alias("__html"))
    return src.mapInArrow(part, "page_id long, url string, text string, n_chars long, n_kept long, n_blocks long")
