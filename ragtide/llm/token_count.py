"""Token counts of a unigram tokenizer, without its tokens.

A text's words are ``[^\\x20\\x09-\\x0D]+``, each read with the word-start mark
before it.  Aho-Corasick enumerates the vocabulary's matches that end at each
character; the dynamic program carries only the best score and its number of
pieces.  Ties follow the tokenizer: a later candidate must be strictly better,
and candidates come by growing start, so of equal ones the longest last piece
wins.  A character that no piece of its own covers costs the lowest score less
10 and counts as its bytes if the vocabulary has byte pieces, otherwise
neighbours of that kind count as one.

Defined cases: a null, empty or blank text has 0 tokens; texts and words may be
of any length; repeated rows are counted alike; an empty table gives no rows;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import SPACE, automaton
from .text import string_buffers

UNKNOWN_PENALTY = 10.0
MEMO = 1_000_000


class Counter:
    def __init__(self, path: str):
        self.find, names, scores = automaton(path)
        self.unknown = min(scores) - UNKNOWN_PENALTY
        known = set(names)
        self.bytes = all(f"<0x{b:02X}>" in known for b in range(256))
        self.memo: dict[bytes, int] = {}

    def word(self, text: str) -> int:
        n = len(text)
        score, count, loose = [None] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        score[0], done = 0.0, 0
        single = [False] * (n + 1)               # a piece of one character ends here

        def close(upto: int) -> None:
            """Characters without a match of their own become unknown ones, end by end."""
            nonlocal done
            while done < upto:
                done += 1
                if not single[done]:
                    s = score[done - 1] + self.unknown
                    if score[done] is None or s > score[done]:
                        score[done], loose[done] = s, True
                        add = len(text[done - 1].encode()) if self.bytes else int(not loose[done - 1])
                        count[done] = count[done - 1] + add

        for last, (_, size, value) in self.find.iter(text):
            end = last + 1
            close(last)                           # every end before this one is final
            s = score[end - size] + value
            if score[end] is None or s > score[end]:     # longest match first, so growing starts
                score[end], count[end], loose[end] = s, count[end - size] + 1, False
            single[end] |= size == 1
        close(n)
        return count[n]

    def text(self, raw: bytes) -> int:
        memo, total = self.memo, 0
        if len(memo) > MEMO:
            memo.clear()
        for w in raw.split():
            c = memo.get(w)
            if c is None:
                c = memo[w] = self.word(SPACE + w.decode())
            total += c
        return total


_WORKER: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _WORKER:
        _WORKER[path] = Counter(path)
    return _WORKER[path]


def token_counts(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and n_words of every row."""
    def part(batches):
        c = counter(path)
        for batch in batches:
            buf, offs = string_buffers(batch.column("__text"))
            raws = (buf[offs[i]: offs[i + 1]].tobytes() for i in range(len(offs) - 1))
            got = [(c.text(r), len(r.split())) for r in raws]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array([g[0] for g in got], pa.int64()),
                                              pa.array([g[1] for g in got], pa.int64())], names=["doc_id", "n_tokens", "n_words"])

    src = df.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("string").alias("__text"))
    return src.mapInArrow(part, "doc_id long, n_tokens long, n_words long")
