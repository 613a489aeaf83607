"""S5/S8 page assembly, W2/W5 history, P13/A10/P12 requests and prompts."""
from datetime import datetime

from pyspark.sql import functions as F

from ragtide.operators import context, history, stats
from ragtide.operators.chunking import split_lines
from ragtide.sources import pages


def test_blank_middle_page_markers(spark):
    p = spark.createDataFrame([("f", 1, "one"), ("f", 2, "  \t"), ("f", 3, "three"), ("g", 1, " ")],
                              "file string, page_no long, text string")
    marked = {r["file"]: r for r in pages.assemble_pages(p, marked=True).collect()}
    assert set(marked) == {"f"}
    assert marked["f"]["text"] == "--- Page 1 ---\none\n\n--- Page 3 ---\nthree\n"
    plain = pages.assemble_pages(p, marked=False).first()
    assert plain["text"] == "one\nthree" and plain["n_pages"] == 2
    summ = {r["file"]: r for r in pages.page_summary(p).collect()}
    assert summ["f"]["characters"] == len(marked["f"]["text"])
    assert (summ["f"]["pages"], summ["f"]["pages_kept"]) == (3, 2)
    assert (summ["g"]["pages"], summ["g"]["pages_kept"], summ["g"]["characters"]) == (1, 0, 0)


def test_two_level_assembly_keeps_order(spark):
    rows = [("f", i, f"p{i}") for i in range(1, 2600)]
    p = spark.createDataFrame(rows, "file string, page_no long, text string")
    out = pages.assemble_pages(p, block_pages=100).first()
    assert out["text"] == "\n".join(f"p{i}" for i in range(1, 2600))


def test_split_lines_rules(spark):
    text = "<01> hotesse\n     h: U B S bonjour\n     \n     <x\n\n  \t\n<02> client\n"
    d = spark.createDataFrame([(1, text)], "doc_id long, content string")
    got = [r["utterance"] for r in split_lines(d).orderBy("line_no").collect()]
    assert got == ["h: U B S bonjour", "", "<x", "  \t"]


def test_history_last_ten(spark):
    rows = [(1, i, f"q{i}", f"a{i}", datetime(2024, 1, 1, 0, 0, i)) for i in range(12)]
    rows += [(2, 0, "only", "one", datetime(2024, 1, 1))]
    h = spark.createDataFrame(rows, "session_id long, seq long, query string, answer string, ts timestamp_ntz")
    out = history.history_last_n(h).where("session_id = 1").orderBy("position").collect()
    assert [r["query"] for r in out] == [f"q{i}" for i in range(2, 12)]
    assert {r["count"] for r in out} == {12}
    assert [r["position"] for r in out] == list(range(1, 11))
    cleared = history.clear_history(h, 1)
    assert cleared.count() == 1


def test_normalize_requests(spark):
    req = spark.createDataFrame([(1, "q?", None, None), (2, None, "k", 3), (3, "", None, None),
                                 (4, None, None, None), (5, "x", None, -1)],
                                "qid long, question string, query string, top_k long")
    out = {r["qid"]: r for r in context.normalize_requests(req).collect()}
    assert (out[1]["question"], out[1]["top_k"], out[1]["status"]) == ("q?", 5, "ok")
    assert (out[2]["question"], out[2]["top_k"]) == ("k", 3)
    assert out[3]["status"] == "rejected" and out[4]["status"] == "rejected"
    assert out[5]["status"] == "rejected"


def test_context_and_prompt(spark):
    hits = spark.createDataFrame([(1, 2, 20, 0.5), (1, 1, 10, 0.9)], "qid long, rank long, id long, similarity double")
    corpus = spark.createDataFrame([(10, "alpha"), (20, "beta")], "id long, corpus string")
    req = spark.createDataFrame([(1, "Quoi ?"), (2, "Rien")], "qid long, question string")
    out = {r["qid"]: r for r in context.context_prompt(hits, corpus, req).collect()}
    assert out[1]["context"] == "alpha beta" and out[1]["sources_count"] == 2
    assert "Contexte: alpha beta\n\nQuestion: Quoi ?\n\n" in out[1]["prompt"]
    assert out[2]["context"] == "" and out[2]["sources_count"] == 0
    src = {r["rank"]: r for r in context.sources(hits, corpus).collect()}
    assert src[1]["relevance"] == 90.0 and src[1]["text"] == "alpha"


def test_stats_on_small_table(spark):
    rows = [(1, "x" * 49, "a", "txt", datetime(2024, 1, 1)), (2, "y" * 500, "a", "txt", datetime(2024, 1, 2)),
            (3, "z" * 120, None, "pdf", datetime(2024, 1, 2))]
    c = spark.createDataFrame(rows, "id long, corpus string, file_name string, file_type string, created_at timestamp_ntz")
    s = stats.corpus_stats(c).first()
    assert (s["total_records"], s["avg_length"], s["unique_files"]) == (3, 223.0, 1)
    assert (s["first_created"], s["last_created"]) == ("2024-01-01T00:00:00", "2024-01-02T00:00:00")
    hist = [(r["category"], r["count"]) for r in stats.length_histogram(c).collect()]
    assert hist == [("Très court (<50)", 1), ("Moyen (100-200)", 1), ("Très long (>500)", 1)]
    recent = [r["id"] for r in stats.recent_rows(c, 2).collect()]
    assert recent == [3, 2]
    empty = stats.corpus_stats(c.where(F.lit(False))).first()
    assert empty["avg_length"] == 0.0 and empty["total_records"] == 0


def test_normalize_requests_page_trim(spark):
    req = spark.createDataFrame([(1, "  hi  ", None), (2, " \t ", None), (3, None, "  q ")],
                                "qid long, question string, query string")
    raw = {r["qid"]: (r["question"], r["status"]) for r in context.normalize_requests(req).collect()}
    assert raw == {1: ("  hi  ", "ok"), 2: (" \t ", "ok"), 3: ("  q ", "ok")}
    t = {r["qid"]: (r["question"], r["status"]) for r in context.normalize_requests(req, trim=True).collect()}
    assert t == {1: ("hi", "ok"), 2: ("", "rejected"), 3: ("q", "ok")}
    # keyword requests: query else keyword, default limit 10
    kw = spark.createDataFrame([(1, None, "cat", None)], "qid long, query string, keyword string, limit long")
    r = context.normalize_requests(kw, primary="query", secondary="keyword", k_col="limit",
                                   default_top_k=context.DEFAULT_KEYWORD_LIMIT).first()
    assert (r["question"], r["top_k"], r["status"]) == ("cat", 10, "ok")


def test_block_level_assembly_joins_to_file_text(spark):
    rows = [("f", i, f"p{i}" if i % 7 else " ") for i in range(1, 700)] + [("g", 1, "x")]
    p = spark.createDataFrame(rows, "file string, page_no long, text string")
    files = {r["file"]: r for r in pages.assemble_pages(p, marked=True, block_pages=50).collect()}
    blocks = pages.assemble_page_blocks(p, marked=True, block_pages=50).collect()
    for f in ("f", "g"):
        bs = sorted((r["block"], r["text"], r["n_pages"]) for r in blocks if r["file"] == f)
        assert "\n".join(t for _, t, _ in bs) == files[f]["text"]
        assert sum(n for _, _, n in bs) == files[f]["n_pages"]
    assert max(r["n_pages"] for r in blocks) <= 50


def test_history_takes_large_conversation_ids(spark):
    turns = spark.createDataFrame([(2**40, 0, "user", "q"), (2**40, 1, "assistant", "a")],
                                  "conv_id long, turn int, role string, text string")
    rows = history.history_last_n(history.interactions_from_turns(turns)).collect()
    assert [(r["session_id"], r["query"], r["answer"], r["count"]) for r in rows] == [(2**40, "q", "a", 1)]


def test_rules_of_each_route(spark):
    from ragtide.operators.context import route_requests
    rows = [(1, "chat", None, "q", "k", None, 3), (2, "chat", "", "q", None, None, None), (3, "search", "x", None, "k", 4, 9),
            (4, "search", "x", "q", "k", None, None), (5, "search", "x", None, None, None, None),
            (6, "semantic-search", "x", None, "k", None, 2), (7, "semantic-search", None, "q", None, 1, None),
            (8, "search", None, "q", None, -1, 5), (9, "other", "x", "q", None, None, None), (10, None, "x", None, None, None, None)]
    df = spark.createDataFrame(rows, "qid int, route string, question string, query string, keyword string, limit int, top_k int")
    got = {r["qid"]: tuple(r)[2:] for r in route_requests(df).collect()}
    assert got == {1: ("q", 3, "ok", None), 2: ("", 5, "rejected", "Question is required"), 3: ("k", 4, "ok", None),
                   4: ("q", 10, "ok", None), 5: ("", 10, "rejected", "Query is required"), 6: ("", 2, "rejected", "Query is required"),
                   7: ("q", 10, "ok", None), 8: ("q", -1, "rejected", "limit must be >= 0"),
                   9: (None, None, "rejected", "Unknown route"), 10: (None, None, "rejected", "Unknown route")}
    assert [tuple(r)[2:4] for r in route_requests(df.select("qid", "route").where("qid = 4")).collect()] == [("", 10)]
