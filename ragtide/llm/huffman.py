"""Canonical length-limited Huffman codes over numpy arrays.

``code_lengths`` is the package-merge method: the best code among those with no
word longer than ``limit`` bits.  Codes are canonical (shorter first, then by
symbol), so the lengths alone name the code.  A stream of symbols is written
most significant bit first, with the bit offset of every ``CHECK``-th symbol
beside it: a decoder can begin at any of these checkpoints, and ``Decoder`` runs from all of them
at once, one table look-up per symbol.
"""

from __future__ import annotations

import numpy as np

LIMIT, CHECK = 20, 128


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol's code (0: the symbol does not occur)."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need codes of more than {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)           # sums of counts below 2^53 are exact
    levels, packages = [], np.empty(0)
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < n)
        both = both[order]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * n - 2                                    # from the last level down: a package stands for two items below it
    for is_leaf in reversed(levels):
        k = int(is_leaf[:take].sum())
        out[used[:k]] += 1
        take = 2 * (take - k)
    return out


def codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol, as a number of its length's bits."""
    out = np.zeros(len(lengths), np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        bits = lengths[order]
        top = int(bits[-1])
        at = np.cumsum(1 << (top - bits)) - (1 << (top - bits))      # left-justified codes in ascending order
        out[order] = at >> (top - bits)
    return out


class Encoder:
    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = np.asarray(lengths, np.int64), codes(np.asarray(lengths, np.int64))

    def encode(self, symbols: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(the stream, padded to whole bytes; bit offsets of the symbols 0, CHECK, 2 CHECK ...)."""
        bits = self.lengths[symbols]
        if not len(bits):
            return b"", np.empty(0, np.uint32)
        if not bits.all():
            raise ValueError("a symbol without a code")
        ends = np.cumsum(bits)
        at = ends - bits
        word, shift = at >> 6, 64 - (at & 63) - bits        # the code's place in a row of 64-bit words
        code = self.codes[symbols].view(np.uint64)
        over = np.flatnonzero(shift < 0)                    # codes that go on in the next word
        own = code << np.maximum(shift, 0).view(np.uint64)
        own[over] = code[over] >> (-shift[over]).view(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros(int(word[-1]) + 2, np.uint64)
        out[word[first]] = np.bitwise_or.reduceat(own, first)
        out[word[over] + 1] |= code[over] << (64 + shift[over]).view(np.uint64)
        return out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], at[::CHECK].astype(np.uint32)


class Decoder:
    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        self.top = int(lengths[order[-1]]) if len(order) else 1
        table = np.repeat(order << 5 | lengths[order], 1 << (self.top - lengths[order])).astype(np.uint32)
        # a single symbol leaves half the table unused
        self.table = np.pad(table, (0, (1 << self.top) - len(table)), constant_values=self.top)

    def decode(self, stream: bytes, checks: np.ndarray, n: int, first: int = 0) -> np.ndarray:
        """The symbols from checkpoint ``first`` on, of a stream of ``n``."""
        pos = checks[first:].astype(np.uint32)
        left = n - first * CHECK
        if left <= 0:
            return np.empty(0, np.uint32)
        b = np.frombuffer(stream + b"\0" * 8, np.uint8).astype(np.uint32)
        word = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
        out = np.empty((min(CHECK, left), len(pos)), np.uint32)
        table, down = self.table, np.uint32(32 - self.top)
        three, seven, low = np.uint32(3), np.uint32(7), np.uint32(31)
        last = left - (len(pos) - 1) * CHECK            # the last lane ends early
        for k in range(len(out)):
            if k == last:
                pos = pos[:-1]
            peek = word[pos >> three]
            peek <<= pos & seven
            peek >>= down
            got = table[peek]
            out[k, : len(pos)] = got
            pos = pos + (got & low)
        return (out >> np.uint32(5)).T.ravel()[:left]
