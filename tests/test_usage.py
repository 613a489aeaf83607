"""The README usage flow, end to end on temporary files: ingest a folder,
then chat, keyword search, statistics and history over the stored table."""
import os

from pyspark.sql import functions as F

from ragtide.operators import context, embed, history, ingest, keyword, stats, topk
from ragtide.sources import files


def test_readme_usage_flow(spark, scratch):
    folder = os.path.join(scratch, "data")
    os.makedirs(folder)
    with open(os.path.join(folder, "105_0000006a.txt"), "wb") as fh:
        fh.write(b"<01> hotesse\n     h: U B S bonjour\n<02> client\n")
    with open(os.path.join(folder, "long.txt"), "w", encoding="utf-8") as fh:
        fh.write("réponse " * 200)
    table = os.path.join(scratch, "corpus")

    # --- as in the README -------------------------------------------------
    docs = files.load_documents(spark, folder)
    ingest.write_corpus(ingest.build_corpus(docs), table)
    corpus = ingest.read_corpus(spark, table)

    req = context.normalize_requests(
        spark.createDataFrame([(1, "bonjour", None)], "qid long, question string, top_k long"))
    ok = embed.embed(req.where(F.col("status") == "ok"), "question", "embedding")
    hits = topk.topk_batch(corpus, ok, k_col="top_k", carry=["corpus"])
    srcs = context.sources(hits, corpus)
    prompt = context.context_prompt(hits, corpus, ok)

    kw = keyword.keyword_search(corpus, "bonjour")
    st = stats.corpus_stats(corpus)
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")],
                                  "conv_id long, turn long, role string, text string")
    hist = history.history_last_n(history.interactions_from_turns(turns))
    # -------------------------------------------------------------------------

    assert corpus.count() == 5                    # 1 chunk + 1600 chars in 4 chunks
    top = srcs.orderBy("rank").first()
    assert top["id"] == 1 and top["relevance"] > 0     # the file that says bonjour ranks first
    assert prompt.first()["sources_count"] == 5
    assert [r["id"] for r in kw.collect()] == [1]
    assert st.first()["total_records"] == 5 and st.first()["unique_files"] == 2
    assert hist.first()["count"] == 1
