"""Keyword search: F1 (one keyword) and F1b (many keywords at once), L3.

F1 is a filter plus ``orderBy(id).limit(n)`` (TakeOrderedAndProject, each
partition keeps n).  Spark turns a plain literal ILIKE into
``Contains(lower(col), ...)``; it is not a parquet pushdown, but only the text
and id columns are read.  A stored corpus with postings answers F1
without a scan (``operators.grams.indexed_search``).

F1b takes the keywords as a table: blocks of distinct keywords meet blocks of texts in tiles
(``operators.grams``), so neither keywords nor matches pass through the driver and one plan
serves any number of keywords.  A tile gives each keyword's number of matching rows and its first ids;
no (keyword, id) pair is shuffled or stored, however many rows a keyword matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragtide.functions.like import ilike_contains
from ragtide.functions.text import iso_timestamp
from ragtide.operators.grams import gram_firsts, gram_matches


def keyword_search(corpus: DataFrame, keyword: str, limit: int = 10, *,
                   text_col: str = "corpus") -> DataFrame:
    """rows whose text contains ``keyword`` (ILIKE rules), the first
    ``limit`` by id: (id, text, date)."""
    hits = corpus.where(ilike_contains(text_col, keyword))
    return (hits.orderBy("id").limit(int(limit))
            .select("id", F.col(text_col).alias("text"), iso_timestamp("created_at").alias("date"),
                    "file_name"))


def keyword_count(corpus: DataFrame, keyword: str, *, text_col: str = "corpus") -> DataFrame:
    """A11 over the whole corpus: number of rows matching the keyword."""
    return corpus.where(ilike_contains(text_col, keyword)).agg(F.count(F.lit(1)).alias("matches"))


def _requests(keywords: DataFrame, qid_col: str, kw_col: str, *more) -> DataFrame:
    return keywords.where(F.col(kw_col).isNotNull() & (F.col(kw_col) != "")).select(
        F.col(qid_col).cast("long").alias("qid"), F.col(kw_col).alias("keyword"), *more)


def keyword_matches(corpus: DataFrame, keywords: DataFrame, *, id_col: str = "id",
                    text_col: str = "corpus", qid_col: str = "qid", kw_col: str = "keyword") -> DataFrame:
    """All (qid, id) pairs where the row text contains the keyword; rows without an id take no part."""
    found = gram_matches(corpus, keywords, id_col=id_col, text_col=text_col, kw_col=kw_col)
    return _requests(keywords, qid_col, kw_col).join(found, "keyword").select("qid", "id")


def keyword_batch(corpus: DataFrame, keywords: DataFrame, limit: int = 10, *, id_col: str = "id",
                  text_col: str = "corpus", qid_col: str = "qid", kw_col: str = "keyword",
                  limit_col: str | None = None) -> DataFrame:
    """For every keyword, its first ``limit`` matching rows by id plus the
    total number of matching rows: (qid, rank, id, matches).  ``limit_col``
    names a per-keyword limit (a request's ``limit``; NULL takes ``limit``).
    Rows without an id take no part; ids are taken to be distinct."""
    lim = F.lit(int(limit)) if limit_col is None else F.coalesce(F.col(limit_col).cast("long"), F.lit(int(limit)))
    req = _requests(keywords, qid_col, kw_col, lim.cast("long").alias("k")).where("k > 0")
    found = gram_firsts(corpus, req.groupBy("keyword").agg(F.max("k").alias("k")), id_col=id_col, text_col=text_col)
    each = found.select("keyword", "n", F.posexplode("ids").alias("_p", "id"))               # of every tile at most k
    w = Window.partitionBy("keyword")
    got = each.select("keyword", F.row_number().over(w.orderBy("id")).cast("long").alias("rank"), "id",
                      F.sum(F.when(F.col("_p") == 0, F.col("n")).otherwise(F.lit(0))).over(w).alias("matches"))
    return req.join(got, "keyword").where(F.col("rank") <= F.col("k")).select("qid", "rank", "id", "matches")
