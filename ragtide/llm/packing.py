"""Best-fit packing by sum of squares.

``tokenise`` turns documents into pieces of at most ``limit`` tokens on the
executors.  ``pack`` deals the pieces that are not full into groups of about
``group_tokens`` tokens by a hash and packs each group in one task by the
sum-of-squares rule: take the pieces longest first and put each one where the sum over
residual gaps g of N(g)^2 becomes smallest, N(g) being the number of open
sequences with gap g (a full sequence is closed and not counted; a new
sequence is one of the choices).  Only N, at most ``limit`` numbers, decides,
so a choice costs O(limit) whatever the number of open sequences.  The few
loose sequences that each group ends with are packed again, many groups together.

Defined cases: a null text is an empty one, whose one piece is the end token;
a text longer than ``limit`` is cut into full pieces and a last one; equal
documents are packed each on their own; an empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .text import string_buffers

LIMIT, END_ID, GROUP_TOKENS = 2048, 0, 2_000_000
SECOND = 64
MEMO = 340_000                  # words a worker remembers: as many as a dict of 2^19 places takes, some 65 MB

# --- fixed values: the word-end tokenizer's own pattern, and the byte-level alphabet, for letters below LETTERS_END ---
LETTERS_END = "\u0250"
_L = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u024f"
PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[0-9]|[!-/:-@\[-`{{-~]+")
PLAIN = re.compile(rf"[0-9!-/:-@\[-`{{-~{_L}]+")
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
# ----------------------------------------------------------------------------------------------------------------------

_WORKER: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class _Memo(dict):
    """Words' ids; a new word is learned when it is asked for."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.learn(word)
        return ids


class WordTokenizer:
    """Token ids of whole texts as the ``tokenizers`` library gives them, remembered by word.

    Right for a tokenizer that lower-cases and never joins across ASCII white space,
    as the word-end BPE here does: a text's ids are then its words' ids in a
    row.  An added token (``<|endoftext|>``) is matched in the raw text first, as the
    library does, and the text is cut there.  A new word of plain letters, with or
    without ASCII punctuation and digits, is cut by the file's own pattern and
    its parts go straight to the library's BPE model; any other word goes through the whole tokenizer.
    About ``MEMO`` words are remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        added = self.tok.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word or not t.content.strip() for t in added.values()):
            raise ValueError("an added token that takes in its surroundings cannot be cut out of a text")
        self.special = {t.content.encode(): struct.pack("<I", i) for i, t in added.items()}
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, longest)) + b")") if longest else None
        self.tok.encode_special_tokens = True          # a word holds no added token any more, whatever lower-casing makes of it
        self.bpe = self.tok.model
        self.raw_ids = [struct.pack("<I", i) for i in range(self.tok.get_vocab_size())]
        self.marks: dict[bytes, bytes] = {}
        self.memo = _Memo(self._word)

    def _part(self, part: str) -> bytes:
        ids = self.raw_ids
        return b"".join([ids[t.id] for t in self.bpe.tokenize(part)])

    def _word(self, raw: bytes) -> bytes:
        core = raw.rstrip(MARKS)
        if core and len(core) < len(raw) and core[-1:].isalnum():      # a run of marks after a letter or digit is a part of its own
            run = raw[len(core):]
            tail = self.marks.get(run)
            if tail is None:
                tail = self._part(run.decode())
                if len(run) < 4:                                       # a bounded number
                    self.marks[run] = tail
            return (self.memo.get(core) or self._word(core)) + tail
        if raw.isalpha():                                              # ASCII letters only
            return self._part(raw.decode())
        word = raw.decode()
        low = word.lower()
        if max(low) < LETTERS_END:
            if low.isalpha():
                return self._part(low.encode().decode("latin-1").translate(BYTE_CHARS))
            if PLAIN.fullmatch(low):
                return b"".join([self._part(p.encode().decode("latin-1").translate(BYTE_CHARS)) for p in PARTS.findall(low)])
        ids = self.tok.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, raw: bytes) -> bytes:
        return b"".join(map(self.memo.__getitem__, raw.lower().split()))

    def encode(self, raws: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text (UTF-8 in)."""
        out = []
        for raw in raws:
            if len(self.memo) > MEMO:
                self.memo.clear()
            if self.cut is not None and self.cut.search(raw):
                out.append(b"".join(self.special[x] if k % 2 else self._plain(x) for k, x in enumerate(self.cut.split(raw))))
            else:
                out.append(self._plain(raw))
        return out


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _WORKER:
        _WORKER[path] = WordTokenizer(path)
    return _WORKER[path]


def tokenise(df: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID, ids: bool = False,
             doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    end = struct.pack("<I", end_id)

    def part(batches):
        tok = _tokenizer(path)
        for batch in batches:
            buf, offs = string_buffers(batch.column("__text"))
            docs = batch.column("__id")
            for i in range(0, len(docs), 64):
                js = range(i, min(i + 64, len(docs)))
                row, cols = [], ([], [], [], [], [])
                for j, b in zip(js, tok.encode([buf[offs[j]: offs[j + 1]].tobytes() for j in js])):
                    b += end
                    for p, at in enumerate(range(0, len(b), 4 * limit)):
                        c = b[at: at + 4 * limit]
                        row.append(j)
                        for col, v in zip(cols, (p, at // 4, len(c) // 4, zlib.crc32(c), c)):
                            col.append(v)
                arrays = [docs.take(pa.array(row, pa.int64())), pa.array(cols[0], pa.int32()),
                          *(pa.array(c, pa.int64()) for c in cols[1:4])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if ids:
                    arrays.append(pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in cols[4]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    src = df.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("string").alias("__text"))
    return src.mapInArrow(part, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


def sum_of_squares(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, offset) of each length, longest first, by the sum-of-squares rule."""
    seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n = np.zeros(limit + 1, np.int64)           # N(g), g = 1 .. limit - 1
    open_at: list[list[int]] = [[] for _ in range(limit + 1)]
    made = 0
    for k in np.argsort(-lengths, kind="stable"):
        ln = int(lengths[k])
        # moving a sequence from gap g to g - ln changes the sum by 2 (N(g-ln) - N(g)) + 2, or 1 - 2 N(g) if it closes
        left = n[: limit - ln + 1]
        cost = 2 * (left - n[ln:]) + 2
        cost[0] = 1 - 2 * n[ln]
        cost[n[ln:] == 0] = np.iinfo(np.int64).max
        fresh = 2 * int(n[limit - ln]) + 1 if ln < limit else 0
        g = int(np.argmin(cost)) + ln if len(cost) else limit
        if len(cost) and n[g] and cost[g - ln] <= fresh:
            s = open_at[g].pop()
            n[g] -= 1
        else:
            s, g, made = made, limit, made + 1
        seq[k], off[k] = s, limit - g
        if g > ln:
            n[g - ln] += 1
            open_at[g - ln].append(s)
    return seq, off


def pack(pieces: DataFrame, limit: int = LIMIT, group_tokens: int = GROUP_TOKENS, loose: int | None = None) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset.

    The pieces are written to the shared folder once, since their number of
    tokens sets the number of groups; a group holds about ``group_tokens``
    however the documents repeat, for a row's place in the written table
    enters the hash that deals it.  Each group ends with a few loose sequences (a
    gap of ``loose`` tokens or more); their pieces are packed once more,
    ``SECOND`` groups together."""
    loose = limit // 32 if loose is None else loose
    pieces = written(pieces, "pieces")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    n_groups = max(1, math.ceil(total / group_tokens))
    names = pieces.columns
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def place(table: pa.Table) -> pa.Table:
        group = table.column("__group")[0].as_py()
        lengths = table.column("length").to_numpy()
        seq, off = sum_of_squares(lengths, limit)
        fill = np.bincount(seq, weights=lengths).astype(np.int64)
        ids = seq * n_groups + group if group >= 0 else -1 - (seq * n_groups - 1 - group)
        return (table.append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(off, pa.int64()))
                .append_column("__gap", pa.array(limit - fill[seq], pa.int64())))

    dealt = (pieces.withColumn("__n", F.monotonically_increasing_id())
             .withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece", "__n"), F.lit(n_groups)).cast("int")).drop("__n"))
    schema = fields + ", __group int, sequence_id long, offset long, __gap long"
    once = written(dealt.groupBy("__group").applyInArrow(place, schema), "packed")
    again = (once.filter(F.col("__gap") >= loose).withColumn("__group", (-1 - F.floor(F.col("__group") / SECOND)).cast("int"))
             .select(*names, "__group").groupBy("__group").applyInArrow(place, schema))
    out = once.filter(F.col("__gap") < loose).unionByName(again)
    return out.select(*names, "sequence_id", "offset")
