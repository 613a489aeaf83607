"""Word and window hashing over Arrow string batches, in numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes.  A word's 64-bit hash is
a polynomial over random byte values, finished by a mixer; a window's hash
combines its words' hashes by position.  Texts are cut into pieces of about
``PIECE`` bytes (only at white space) so a very long text needs no more memory
than its own word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
PIECE = 1 << 18
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.default_rng(20240101)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = int(_RNG.integers(2**40, 2**62)) * 2 + 1
_COEF = _RNG.integers(1, 2**63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_POW = _INV = np.empty(0, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, PIECE + (1 << 16))
        inv = pow(_BASE, -1, 2**64)
        out = []
        for b in (_BASE, inv):
            a = np.full(size, b, U64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=U64))
        _POW, _INV = out
    return _POW, _INV


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher, element-wise."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset: col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[offs[0]: offs[-1]], offs - offs[0]


def groups(offs: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of at most ``limit`` bytes together (a longer text is a run of its own)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _hash_piece(b: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(b)
    if not n:
        return np.empty(0, U64), np.zeros(len(offs), np.int64)
    word = ~sep[b]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offs[(offs > 0) & (offs < n)]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inner - 1] = word[inner - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    pw, inv = _powers(n)
    v = _BYTE[b] * pw[:n]
    c = np.cumsum(v, dtype=U64)
    h = (c[e] - c[s] + v[s]) * inv[s] + (e - s + 1).astype(U64) * _COEF[63]
    return mix(h), np.searchsorted(s, offs)


def word_hashes(buf: np.ndarray, offs: np.ndarray, sep: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, index of each text's first word; one more at the end).  ``buf`` holds the texts at ``offs``."""
    if offs[-1] <= 2 * PIECE or len(offs) != 2:
        return _hash_piece(buf[: offs[-1]], offs, sep)
    out, at, end = [], 0, int(offs[-1])
    while at < end:                       # one long text, cut at separators
        to = min(at + PIECE, end)
        while to < end:
            cut = np.flatnonzero(sep[buf[to: to + PIECE]])
            if len(cut):
                to += int(cut[0])
                break
            to = min(to + PIECE, end)
        out.append(_hash_piece(buf[at:to], np.array([0, to - at]), sep)[0])
        at = to
    h = np.concatenate(out)
    return h, np.array([0, len(h)])


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes (empty if there are fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    s = np.full(n, U64(k) * _COEF[62])
    for j in range(k):
        s += h[j: j + n] * _COEF[j]
    return mix(s)


def int_column(values, typ=None) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64), type=typ or pa.int64())
