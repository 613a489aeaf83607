"""A training corpus from ``documents``: five stages, each over all rows that
the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.  ``run`` writes each stage's rows to the shared
folder and reads them again for the next.  Defined cases: each stage's module states
its own; rows with a null text go with the first stage, an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragtide.llm import mixing, packing, pii, quality, shingle_join
from ragtide.llm.queries import KEY
from ragtide.llm.shared import written
from ragtide.session import ship_package
from ragtide.sources.tables import table

TEXT_ROWS = 1_000


def ship(spark: SparkSession) -> None:
    """The package reaches the workers, and whole texts go there at most ``TEXT_ROWS`` rows at a time."""
    ship_package(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= TEXT_ROWS:
        spark.conf.set(rows, str(TEXT_ROWS))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    ship(spark)
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays."""
    ship(spark)
    return shingle_join.keep_one(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced; ``n_chars`` is the new text's length."""
    ship(spark)
    cols = docs.columns
    done = pii.pseudonymise(docs, KEY, keep=[c for c in cols if c != "text"])
    rest = {c: f"__x{k}" for k, c in enumerate(c for c in cols if c != "text")}
    return done.select(*(F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars"
                         else F.col(rest[c]).alias(c) for c in cols))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document appears as often as the mix draws it, whole.  The last one drawn of a
    source, of which the quota asks a part, is taken if that part is half of it or more,
    and left out otherwise.  The rows are written in the order of the mix: by shard, then position."""
    ship(spark)
    cols = docs.columns
    drawn = mixing.mix(docs, keep=cols)
    drawn = drawn.select("size", F.explode("draws").alias("draw"), *(f"__x{k}" for k in range(len(cols))))
    drawn = drawn.filter(2 * F.col("draw.words") >= F.col("size"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = drawn.repartitionByRange(parts, "draw.shard", "draw.position").sortWithinPartitions("draw.shard", "draw.position")
    return drawn.select(*(F.col(f"__x{k}").alias(c) for k, c in enumerate(cols)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, placed in sequences."""
    ship(spark)
    return packing.pack(packing.tokenise(docs, packing.default_tokenizer()))


STAGES = [("quality rules", good_quality), ("n-gram Jaccard join", one_of_each), ("pii", pseudonyms),
          ("mixing", mixed), ("best-fit packing", packed)]
ORACLE_SQL = None        # hashes, fitted references and packing have no SQL form; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
