"""The subpackage's registered queries: each applies its operator to its whole
table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import html_text, langid, mixing, packing, pii, pieces, prefix_trie, quality, runs, sharding, shingle_join, token_count, token_files, vector_dups
from .shared import written

# the registered queries' key; a real run passes its own
KEY = b"ragtide-pseudonyms"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenise(table(spark, sf_dir, "documents"), packing.default_tokenizer())
    return packing.pack(pieces)


def op2_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), KEY)


def op6_vector_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), pieces.default_vocabulary())


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), pieces.default_vocabulary())


def rewritten(df: DataFrame) -> DataFrame:
    """The contract's documents for op11: in a tenth of them the words from one place on repeat the first ones there."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")
    cut = df.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    cut = cut.withColumn("n", F.size("w").cast("long"))
    cut = cut.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    cut = cut.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.expr("transform(sequence(a, n - 1), i -> w[cast(a + (i - a) % p as int)])")
    new = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), again), " ")
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), new).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(rewritten(table(spark, sf_dir, "documents")))
    top = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    got = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"),
                       F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return got.select("doc_id", "n_runs", (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
                      F.floor(1000 * F.col("top.length") / -F.col("top.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations for op12 from ``ordered`` turns: (their turns, their ids).  Each takes
    its first turns, at most 8, from the conversation whose id is the next multiple of 5 below."""
    turns = written(turns, "ordered")
    sizes = written(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size")), "sizes")
    h = F.crc32(F.col("conv_id").cast("string")) % 9
    base = (F.col("conv_id") - F.pmod("conv_id", F.lit(5)))
    of = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("has"))
    convs = (sizes.select("conv_id", h.alias("h"), base.alias("base")).join(of, "base", "left")
             .select("conv_id", "base", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("taken")))
    convs = written(convs, "convs")
    first = turns.filter((F.pmod("conv_id", F.lit(5)) == 0) & (F.col("pos") < 8)).withColumnRenamed("conv_id", "base")
    first = first.join(convs.select("base", "conv_id", "taken"), "base").filter("pos < taken").select(*turns.columns)
    own = turns.filter(F.col("pos") >= h)
    own = prefix_trie.joined(own, convs.select("conv_id", "h", "taken"), ["conv_id"], prefix_trie.hot_keys(own, ["conv_id"]))
    own = own.withColumn("pos", F.col("pos") - F.col("h") + F.col("taken")).select(*turns.columns)
    return first.unionByName(own), convs.select("conv_id")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    trie = prefix_trie.Trie(*rebuilt(prefix_trie.ordered(table(spark, sf_dir, "conversations"))))
    none = F.sha2(F.lit(""), 256)
    got = trie.nodes.join(prefix_trie.members_sha256(trie.ends), prefix_trie.KEY, "left")
    return got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
                      F.coalesce("sha", none).alias("ends_sha256"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the corpus's token files and answers from what is read back."""
    folder = token_files.write_tokens(table(spark, sf_dir, "documents"), packing.default_tokenizer())
    got = token_files.read_tokens(spark, folder)
    return got.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_shingle_join, op3_html_text, op4_sharding, op5_pii, op6_vector_dups, op7_mixing, op8_quality,
                                   op9_langid, op10_token_counts, op11_periodic_runs, op12_prefix_trie, op13_token_files)}
SQL: dict[str, str] = {}
