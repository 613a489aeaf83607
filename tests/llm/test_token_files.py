"""Token files: the code against an optimal one, the files against the tokenizer, an exact round trip."""

import heapq
import itertools
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ragtide.llm import huffman, packing, queries, token_files
from ragtide.sources.tables import table

from .test_llm import DOCS, ODD, SMALL, docs, made, none, odd  # noqa: F401


def least_bits(counts):
    """Cost of Huffman's own code."""
    h = [c for c in counts if c]
    heapq.heapify(h)
    cost = 0
    while len(h) > 1:
        a, b = heapq.heappop(h), heapq.heappop(h)
        cost += a + b
        heapq.heappush(h, a + b)
    return cost


def test_code_lengths():
    rng = np.random.default_rng(1)
    for _ in range(100):
        c = rng.integers(0, 3, rng.integers(2, 60)) * rng.integers(0, 1000, 1)
        c = c * rng.integers(1, 50, len(c))
        if (c > 0).sum() > 1:
            le = huffman.code_lengths(c, 20)
            assert ((le > 0) == (c > 0)).all() and (2.0 ** -le[c > 0]).sum() <= 1 and (le * c).sum() == least_bits(c.tolist())
    for _ in range(20):                                 # with a limit: the best of all lengths that fit Kraft's inequality
        c = rng.integers(1, 200, 6) ** 2
        best = min(sum(a * b for a, b in zip(c, x)) for x in itertools.product((1, 2, 3), repeat=6) if sum(2.0 ** -b for b in x) <= 1)
        le = huffman.code_lengths(c, 3)
        assert le.max() <= 3 and (le * c).sum() == best
    assert huffman.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0] and not huffman.code_lengths(np.zeros(4)).any()
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9), 3)


def test_codes_are_canonical():
    le = np.array([3, 0, 1, 3, 2])
    assert [format(c, f"0{n}b") for c, n in zip(huffman.codes(le), le) if n] == ["110", "0", "111", "10"]


def test_streams():
    rng = np.random.default_rng(2)
    for n in (0, 1, 255, 256, 257, 512, 5000):
        c = rng.integers(0, 1000, 300)
        c[:3] = [1, 10**9, 0]
        s = rng.choice(np.flatnonzero(c), n)
        le = huffman.code_lengths(c)
        stream, checks = huffman.Encoder(le).encode(s)
        bits = "".join(format(huffman.codes(le)[x], f"0{le[x]}b") for x in s)
        assert stream == int((bits + "0" * (-len(bits) % 8)) or "0", 2).to_bytes(-(-len(bits) // 8), "big") and len(checks) == -(-n // huffman.CHECK)
        for k in range(len(checks)):
            assert (huffman.Decoder(le).decode(stream, checks, n, k) == s[k * huffman.CHECK:]).all()
    one = huffman.code_lengths(np.array([0, 7]))
    stream, checks = huffman.Encoder(one).encode(np.ones(9, int))
    assert (huffman.Decoder(one).decode(stream, checks, 9) == 1).all()


def check_files(rows, got):
    """Against a fresh tokenizer; documents of one doc_id may stand in any order among themselves."""
    tok = Tokenizer.from_file(packing.default_tokenizer())
    key = lambda i: (i is not None, i)
    want = sorted(((i, tok.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, *_ in rows), key=lambda r: key(r[0]))
    got = sorted(got, key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got] == [i for i, _ in want]
    crc = lambda ids: zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
    assert sorted((key(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((key(i), len(x), crc(x)) for i, x in want)


def test_query(spark, docs):  # noqa: F811
    check_files(docs, queries.op13_token_files(spark, SMALL).collect())


SPECIAL = [(20, "hello <|endoftext|> world", "en", "a"), (21, "a<|startoftext|>b <|ENDOFTEXT|> don't It's 3,4!! ça", "en", "a"),
           (22, "İstanbul Σ ΟΔΟΣ É é ​ 中文 日本語\u0085x ŉ ǅ ²½ ́a x’s", None, None)]


def test_odd_rows_and_ranges(spark, none):  # noqa: F811
    rows = ODD + SPECIAL + [(30, "the same row " * 9, "en", "a")] * 40
    df = made(spark, rows).repartition(5)
    folder = token_files.write_tokens(df, packing.default_tokenizer(), block=700)
    got = token_files.read_tokens(spark, folder)
    check_files(rows, got.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")).collect())
    stream = np.concatenate([np.frombuffer(bytes(r["ids"]), "<u4") for r in got.orderBy("start").collect()])
    for a, n in ((0, 1), (0, 10**6), (699, 3), (1500, 2600), (len(stream) - 5, 50), (len(stream), 4), (300, 0)):
        assert (token_files.read_range(spark, folder, a, n) == stream[a: a + n]).all()
    empty = token_files.write_tokens(none, packing.default_tokenizer())
    assert token_files.read_tokens(spark, empty).count() == 0 and len(token_files.read_range(spark, empty, 0, 9)) == 0


def test_word_ids_are_the_tokenizers(spark):
    """The remembered words against the whole tokenizer, as the contract calls it."""
    rng = np.random.default_rng(5)
    letters = list("abcxyzABC'''’éÉßüñçşŞİıĿŀŉǅǆªºµ0123456789²½.,;:!?<|>_-^`~\"()[]{}$€«»  ́̈KÅ ẞǆœΣσςαβжЖ中日ก้\U0001F600​\u0085")
    whole = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'re", "don't", "I'll", "'S", "é", "abc.", "abc,,"]
    tok, words = Tokenizer.from_file(packing.default_tokenizer()), packing.WordTokenizer(packing.default_tokenizer())
    texts = ["".join(rng.choice(whole) if rng.random() < .15 else rng.choice(letters) for _ in range(rng.integers(0, 15))) for _ in range(5000)]
    for t in texts + [r[1] for r in SPECIAL]:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert words.encode([t.encode()]) == [struct.pack(f"<{len(ids)}I", *ids)], t
