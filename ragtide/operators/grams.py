"""Character trigrams: the keyword join (F1b) and a posting table for F1.

A text's grams are the hashes of its lower-cased runs of three characters.  A
pattern needs every trigram of its literal stretches (between wildcards), so a text
without one of them cannot match; what has them is verified by the ILIKE rules.
A pattern whose longest literal stretch has two characters or one has that stretch itself as its
gram, one of wildcards alone the empty gram, which every text has.

``gram_matches`` and ``gram_firsts`` join many keywords with a corpus, both tables, by tiles:

1. the texts are dealt by hash into blocks of about ``TEXT_BYTES``, the distinct keywords into
   blocks of ``TILE_WORDS``; a text is sent once to every block of keywords, a
   keyword once to every block of texts, and a block pair meets in one task (a cogroup);
2. a task counts the grams of a slice of its texts, looks for each keyword's rarest
   gram there, and verifies the texts that hold it by the ILIKE rules;
3. what leaves a tile is its matches, or for each keyword their number and the first ids: no
   pair of a keyword and a text is shuffled or stored for the latter.

``write_postings`` stores, for every gram, the ids of the texts that hold it: bit maps
of blocks of 2^16 ids, in folders by gram, and the texts in folders by id range.
``indexed_search`` reads the postings of one pattern's grams, intersects them block by block,
and verifies ILIKE on the texts of the blocks left.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragtide.functions.like import contains_pattern, contains_pattern_literal, ilike_contains
from ragtide.session import shared_table

SKETCH = 1 << 18                  # counters of a slice's grams
HOT_ROWS = 100_000                # texts of a tile at most
TEXT_BYTES, TILE_WORDS = 16 << 20, 10_000       # texts and keywords of a tile
PAIR_BYTES = 4 << 20              # texts of a tile that returns all its pairs
SLICE_CHARS, SLICE_MARKS = 1 << 20, 1 << 26     # of the texts handled at a time
FOLDERS, ID_BLOCK, TEXT_BLOCKS = 256, 1 << 16, 16
_SLICE = 2048                     # texts handled at a time
EMPTY = np.uint64(0)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _hashes(chars: np.ndarray, n: int) -> np.ndarray:
    """A number for every run of n <= 3 of these characters: 21 bits each and a mark for n, mixed.  Different runs have different numbers."""
    m = len(chars) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    x = chars[:m].astype(np.uint64)
    for k in range(1, n):
        x = (x << _U(21)) | chars[k: k + m]
    return _mix(x | _U((1 << 63, 1 << 50, 1 << 40)[3 - n]))


def all_grams(texts: list[str | None], short: bool = True):
    """Pieces (text, gram) of the grams of each text, which Spark has lower-cased, repeats included: runs
    of three characters and, where ``short``, of two and one, and the empty gram.  A null text has none."""
    here = np.array([i for i, t in enumerate(texts) if t is not None], np.int64)
    low = [texts[i] for i in here]
    # one code between texts keeps runs apart
    flat = np.frombuffer("\0".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in low], np.int64)
    owner = np.repeat(here, sizes + 1)[: len(flat)]
    left = np.repeat(np.cumsum(sizes + 1) - 1, sizes + 1)[: len(flat)] - np.arange(len(flat))      # characters of the text from here on
    for n in (3, 2, 1) if short else (3,):
        g = _hashes(flat, n)
        ok = left[: len(g)] >= n
        yield owner[: len(g)][ok], g[ok]
    if short:
        yield here, np.zeros(len(low), np.uint64)


def text_grams(texts: list[str | None], short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram) of the distinct grams of each text."""
    who, what = (np.concatenate(x) for x in zip(*all_grams(texts, short)))
    order = np.lexsort((what, who))
    who, what = who[order], what[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (what[1:] != what[:-1])
    return who[new], what[new]


def literal_stretches(pattern: str) -> list[str]:
    """The literal stretches of a normalised LIKE pattern."""
    out, now, i = [], "", 0
    while i < len(pattern):
        if pattern[i] == "\\" and i + 1 < len(pattern):
            now, i = now + pattern[i + 1], i + 2
        elif pattern[i] in "%_":
            out, now, i = out + [now], "", i + 1
        else:
            now, i = now + pattern[i], i + 1
    return [s for s in out + [now] if s]


def pattern_grams(pattern: str) -> np.ndarray:
    """The grams that every text matching the lower-cased pattern holds: all trigrams, or else the longest shorter stretch, or the empty gram."""
    codes = [np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) for s in literal_stretches(pattern)]
    three = [_hashes(c, 3) for c in codes if len(c) >= 3]
    if three:
        return np.unique(np.concatenate(three))
    if not codes:
        return np.array([EMPTY])
    c = max(codes, key=len)
    return _hashes(c, len(c))


def _at(grams: np.ndarray) -> np.ndarray:
    return (grams & _U(SKETCH - 1)).astype(np.int64)


def like_regex(pattern: str) -> re.Pattern:
    """The whole-text regex of a normalised LIKE pattern.  What stands between two ``%`` is taken at its first
    place, for good: a later one leaves less room, so nothing is lost, and the search does not back up."""
    parts, i = [""], 0
    while i < len(pattern):
        if pattern[i] == "\\" and i + 1 < len(pattern):
            i += 1
            parts[-1] += re.escape(pattern[i])
        elif pattern[i] == "%":
            parts.append("")
        else:
            parts[-1] += "." if pattern[i] == "_" else re.escape(pattern[i])
        i += 1
    inner = "".join(f"(?>.*?{x})" for x in parts[1:-1] if x)
    return re.compile(parts[0] if len(parts) == 1 else f"{parts[0]}{inner}.*{parts[-1]}", re.S)


class _Words:
    """A tile's keywords: the grams of each and its test."""

    def __init__(self, words: pa.Table):
        self.tests = []
        for word, low, pattern in zip(*(words.column(c).to_pylist() for c in ("keyword", "low", "pattern"))):
            plain = not set(word) & set("%_\\")
            # a plain keyword of up to three characters is its gram: nothing is left to verify
            self.tests.append(like_regex(pattern).fullmatch if not plain else None if len(low) <= 3 else low)
        per = [pattern_grams(p) for p in words.column("pattern").to_pylist()]
        self.grams = np.concatenate(per)
        self.owner = np.repeat(np.arange(len(per)), [len(g) for g in per])
        self.first = np.flatnonzero(np.r_[True, self.owner[1:] != self.owner[:-1]])

    def hits(self, texts: list[str]):
        """(keyword's number, places of the texts that match, ascending) for every keyword found in a slice."""
        pieces = list(all_grams(texts))
        counts = sum(np.bincount(_at(g), minlength=SKETCH) for _, g in pieces)
        mine = counts[_at(self.grams)]
        least = np.minimum.reduceat(mine, self.first)
        rare = np.flatnonzero((mine == least[self.owner]) & (mine > 0))
        live, at = np.unique(self.owner[rare], return_index=True)      # keywords all of whose grams may be here
        chosen, gram = np.unique(self.grams[rare[at]], return_inverse=True)
        if not len(live):
            return
        slot = np.full(SKETCH, -1, np.int64)
        slot[_at(chosen)] = np.arange(len(chosen))
        held = np.zeros((len(chosen), len(texts)), bool)
        for who, g in pieces:
            k = slot[_at(g)]
            near = k >= 0
            who, g, k = who[near], g[near], k[near]
            other = np.flatnonzero(chosen[k] != g)                     # of the same counter
            k[other] = np.minimum(np.searchsorted(chosen, g[other]), len(chosen) - 1)
            ok = chosen[k] == g
            held[k[ok], who[ok]] = True
        for word, k in zip(live.tolist(), gram.tolist()):
            found, test = np.flatnonzero(held[k]), self.tests[word]
            if isinstance(test, str):
                found = np.array([i for i in found.tolist() if test in texts[i]], np.int64)
            elif test is not None:
                found = np.array([i for i in found.tolist() if test(texts[i])], np.int64)
            if len(found):
                yield word, found


def _slices(texts: list[str], words: int):
    """Runs [i, j) of texts of at most ``SLICE_CHARS`` together (a longer text is a run of its own) and a bounded number of marks."""
    most, i, n = max(1, SLICE_MARKS // words), 0, 0
    for j, t in enumerate(texts):
        if j > i and (n + len(t) > SLICE_CHARS or j - i == most):
            yield i, j
            i, n = j, 0
        n += len(t) + 1
    if texts:
        yield i, len(texts)


def _tiles(corpus: DataFrame, words: DataFrame, summary, schema: str, text_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """``summary(words, ids, hits)`` of every tile; words: keyword, maybe more columns, a row for each keyword;
    ids: the tile's, ascending; hits: (keyword's number, places in ids), a keyword's in ascending order."""
    rows = (corpus.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("id"), F.lower(text_col).alias("_text")))
    words = shared_table(words.select("*", F.lower("keyword").alias("low"), F.lower(contains_pattern("keyword")).alias("pattern")), "keywords")

    def sizes(df, col):
        """Two numbers."""
        r = next(iter(df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(col)), F.lit(0)).alias("b")).toLocalIterator()))
        return r["n"], r["b"]

    n, size = sizes(rows, "_text")
    m, word_size = sizes(words, "pattern")
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    tbs = max(1, -(-size // text_bytes), -(-n // HOT_ROWS), min(4 * cores, -(-n // 1_000)))   # of a small set, some tiles of some texts for every core
    wbs = max(1, -(-m // TILE_WORDS), -(-word_size // TEXT_BYTES))
    block = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    def tile(words: pa.Table, texts: pa.Table) -> pa.Table:
        if not words.num_rows or not texts.num_rows:
            return summary(words, np.empty(0, np.int64), ())
        order = np.argsort(texts.column("id").to_numpy(), kind="stable")
        ids = texts.column("id").to_numpy()[order]
        low = texts.column("_text").take(pa.array(order)).to_pylist()
        asked = _Words(words)
        return summary(words, ids, ((w, i + found) for i, j in _slices(low, words.num_rows) for w, found in asked.hits(low[i:j])))

    left = words.withColumn("_wb", block(wbs, "keyword")).withColumn("_tb", every(tbs))
    right = rows.withColumn("_tb", block(tbs, "id", "_text")).withColumn("_wb", every(wbs))
    return left.groupBy("_wb", "_tb").cogroup(right.groupBy("_wb", "_tb")).applyInArrow(tile, schema)


def gram_matches(corpus: DataFrame, keywords: DataFrame, *, id_col: str = "id", text_col: str = "corpus", kw_col: str = "keyword") -> DataFrame:
    """(keyword, id): every distinct keyword and every row whose text contains it by the ILIKE rules.

    Null and empty keywords and null texts match nothing; rows without an id take no part; ids are taken to be distinct."""
    def pairs(words, ids, hits):
        hits = list(hits)
        who = np.concatenate([np.empty(0, np.int64), *(x for _, x in hits)])
        what = np.repeat(np.array([w for w, _ in hits], np.int64), [len(x) for _, x in hits])
        return pa.table([words.column("keyword").take(pa.array(what)), pa.array(ids[who])], names=["keyword", "id"])

    words = keywords.select(F.col(kw_col).alias("keyword")).where("keyword is not null and keyword <> ''").distinct()
    return _tiles(corpus, words, pairs, "keyword string, id long", PAIR_BYTES, id_col, text_col)


def gram_firsts(corpus: DataFrame, words: DataFrame, *, id_col: str = "id", text_col: str = "corpus") -> DataFrame:
    """(keyword, n, ids): a tile's number of rows whose text contains the keyword and the first ``k`` of their ids, for
    every tile that has some.  ``words``: keyword (not empty, each once), k; the rules are those of ``gram_matches``."""
    def firsts(words, ids, hits):
        k = words.column("k").to_numpy()
        n, had, got = np.zeros(len(k), np.int64), [0] * len(k), [[] for _ in k]
        for w, found in hits:
            n[w] += len(found)
            if had[w] < k[w]:
                got[w].append(ids[found[: k[w] - had[w]]])
                had[w] += len(got[w][-1])
        some = np.flatnonzero(n)
        return pa.table([words.column("keyword").take(pa.array(some)), pa.array(n[some]), pa.array([np.concatenate(got[w]) for w in some], pa.list_(pa.int64()))],
                        names=["keyword", "n", "ids"])

    return _tiles(corpus, words, firsts, "keyword string, n long, ids array<long>", TEXT_BYTES, id_col, text_col)


# --- a stored corpus with its postings ------------------------------------------------

def write_postings(corpus: DataFrame, path: str, *, id_col: str = "id", text_col: str = "corpus") -> None:
    """Store the corpus for ``indexed_search`` under ``path``: its rows in folders by id range, and the postings of its trigrams.

    Ids are distinct and not negative; a row without an id cannot be stored."""
    blocked = corpus.withColumn("_block", F.floor(F.col(id_col) / F.lit(ID_BLOCK * TEXT_BLOCKS)).cast("long"))
    spark = corpus.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocked.repartitionByRange(parts, id_col).write.partitionBy("_block").parquet(f"{path}/texts")

    def part(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, _SLICE):
                piece = batch.slice(i, _SLICE)
                who, what = text_grams(piece.column("_text").to_pylist(), short=False)
                ids = piece.column("id").to_numpy()[who]
                block, low = ids // ID_BLOCK, (ids % ID_BLOCK).astype("<u2")
                order = np.lexsort((low, block, what))
                what, block, low = what[order], block[order], low[order]
                if not len(what):
                    continue
                cut = np.flatnonzero(np.r_[True, (what[1:] != what[:-1]) | (block[1:] != block[:-1])])
                ends = np.r_[cut[1:], len(what)]
                yield pa.RecordBatch.from_arrays([pa.array(what[cut].view(np.int64)), pa.array(block[cut]), pa.array([low[s:e].tobytes() for s, e in zip(cut, ends)], pa.binary())],
                                                 names=["gram", "block", "ids"])

    def merge(key, table):
        """All ids of one block, by gram: at most 2^16 texts whatever their grams."""
        gram, blobs = table.column("gram").to_numpy(), table.column("ids").to_pylist()
        out, order = [], np.argsort(gram, kind="stable")
        cut = np.flatnonzero(np.r_[True, gram[order][1:] != gram[order][:-1]])
        for s, e in zip(cut, np.r_[cut[1:], len(order)]):
            ids = np.sort(np.concatenate([np.frombuffer(blobs[j], "<u2") for j in order[s:e]]))
            raw = np.diff(ids, prepend=np.uint16(0)).astype("<u2").tobytes()
            out.append((int(gram[order[s]]), int(key[1].as_py()), len(ids), zlib.compress(raw, 1) if len(raw) > 64 else raw))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["gram", "block", "n", "ids"])

    src = corpus.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.lower(text_col).alias("_text"))
    posted = src.mapInArrow(part, "gram long, block long, ids binary").withColumn("folder", F.pmod("gram", F.lit(FOLDERS)).cast("int"))
    merged = posted.groupBy("folder", "block").applyInArrow(merge, "gram long, block long, n long, ids binary")
    merged = merged.withColumn("folder", F.pmod("gram", F.lit(FOLDERS)).cast("int"))
    merged.repartition(parts, "folder", "block").sortWithinPartitions("folder", "gram", "block").write.partitionBy("folder").parquet(f"{path}/postings")


def candidate_ids(spark: SparkSession, path: str, keyword: str) -> DataFrame | None:
    """(id, _block) of the stored rows that hold every trigram of the pattern; None if it has no trigram."""
    pattern = spark.sql("select lower(:p)", args={"p": contains_pattern_literal(keyword)}).first()[0]
    if not any(len(s) >= 3 for s in literal_stretches(pattern)):
        return None
    grams = [int(g) for g in pattern_grams(pattern).view(np.int64)]
    posts = spark.read.schema("gram long, block long, n long, ids binary, folder int").parquet(f"{path}/postings")
    mine = posts.where(F.col("folder").isin(sorted({g % FOLDERS for g in grams})) & F.col("gram").isin(grams)).select("block", "n", "ids")
    need = len(grams)

    def meet(table: pa.Table) -> pa.Table:
        """One block's postings, one a gram: the ids in all of them."""
        block, left = table.column("block")[0].as_py(), None
        if table.num_rows == need:
            order = np.argsort(table.column("n").to_numpy(), kind="stable")
            blobs, sizes = table.column("ids").to_pylist(), table.column("n").to_pylist()
            for j in order:
                raw = blobs[j] if len(blobs[j]) == 2 * sizes[j] and sizes[j] <= 32 else zlib.decompress(blobs[j])
                ids = np.cumsum(np.frombuffer(raw, "<u2").astype(np.int64))
                left = ids if left is None else left[np.isin(left, ids, assume_unique=True)]
                if not len(left):
                    break
        ids = np.empty(0, np.int64) if left is None else left + block * ID_BLOCK
        return pa.table([pa.array(ids), pa.array(ids // (ID_BLOCK * TEXT_BLOCKS))], names=["id", "_block"])

    return mine.groupBy("block").applyInArrow(meet, "id long, _block long")


def indexed_search(spark: SparkSession, path: str, keyword: str, limit: int = 10, *, id_col: str = "id", text_col: str = "corpus") -> DataFrame:
    """F1 over a stored corpus: its rows whose text contains ``keyword`` (ILIKE rules), the first
    ``limit`` by id.  Only the folders of texts that hold a candidate are read; a pattern without three literal characters in a row scans."""
    texts = spark.read.parquet(f"{path}/texts")
    found = candidate_ids(spark, path, keyword)
    if found is not None:
        found = found.withColumnRenamed("id", id_col)
        texts = texts.join(F.broadcast(found.select("_block").distinct()), "_block", "left_semi")      # a row per folder of texts: prunes the scan
        texts = texts.join(found.select(id_col), id_col, "left_semi")
    return texts.where(ilike_contains(text_col, keyword)).orderBy(id_col).limit(int(limit)).drop("_block")


def text_share(spark: SparkSession, path: str, keyword: str) -> float:
    """Share of the stored texts' bytes in the folders that ``indexed_search`` reads for this pattern."""
    texts = spark.read.parquet(f"{path}/texts")
    col = next(f.name for f in texts.schema.fields if f.dataType.simpleString() == "string")
    size = F.sum(F.octet_length(col))
    found = candidate_ids(spark, path, keyword)
    if found is None:
        return 1.0
    read = texts.join(F.broadcast(found.select("_block").distinct()), "_block", "left_semi").agg(size).first()[0] or 0
    return read / max(texts.agg(size).first()[0] or 0, 1)
