"""ILIKE rules (F1) and the batch keyword matcher (F1b) against brute force."""
from pyspark.sql import functions as F

from ragtide.functions.like import contains_pattern_literal, ilike_contains
from ragtide.operators import keyword


def test_pattern_normalisation():
    assert contains_pattern_literal("a\\b") == "%ab%"
    assert contains_pattern_literal("50\\%") == "%50\\%%"
    assert contains_pattern_literal("x\\\\y") == "%x\\\\y%"


def test_ilike_rules(spark):
    df = spark.createDataFrame([("a_bc",), ("50% off",), ("xab",), ("XAB",), ("50 off",), ("a\\b",)], "t string")

    def hits(kw):
        return sorted(r["t"] for r in df.where(ilike_contains("t", kw)).collect())

    assert hits("_b") == sorted(["a_bc", "xab", "XAB", "a\\b"])   # '_' matches any one character
    assert hits("50\\%") == ["50% off"]                          # escaped percent is literal
    assert hits("a\\b") == sorted(["xab", "XAB"])                # '\b' reads as 'b'
    # column keyword gives the same answer
    j = df.withColumn("k", F.lit("_b")).where(ilike_contains("t", F.col("k")))
    assert sorted(r["t"] for r in j.collect()) == hits("_b")


def test_keyword_search_orders_by_id_and_limits(spark):
    rows = [(i, f"row {i} {'Hello' if i % 3 == 0 else 'bye'}", None, "f") for i in range(30, 0, -1)]
    c = spark.createDataFrame(rows, "id long, corpus string, created_at timestamp_ntz, file_name string")
    out = keyword.keyword_search(c, "hello", limit=4).collect()
    assert [r["id"] for r in out] == [3, 6, 9, 12]


def test_keyword_batch_matches_brute_force(spark):
    texts = ["the cat sat", "Concatenate THE strings", "dog", "a_b c", "cathedral", "über Straße", ""]
    c = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "id long, corpus string")
    kws = ["cat", "the", "a_b", "STRASSE", "über", "zzz", "a\\_b"]
    k = spark.createDataFrame([(i, w) for i, w in enumerate(kws)], "qid long, keyword string")
    got = {(r["qid"], r["id"]) for r in keyword.keyword_matches(c, k).collect()}
    want = set()
    for q, w in enumerate(kws):
        for r in c.where(ilike_contains("corpus", w)).collect():
            want.add((q, r["id"]))
    assert got == want
    top = keyword.keyword_batch(c, k, limit=1).collect()
    assert {(r["qid"], r["rank"]) for r in top} == {(q, 1) for q, _ in want}


def test_salted_grams_give_same_answer(spark, monkeypatch):
    from ragtide.operators import grams
    texts = ["the cat sat", "Concatenate THE strings", "dog", "a_b c", "cathedral", "über Straße"] * 5
    c = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "id long, corpus string")
    kws = ["cat", "the", "a_b", "über", "zzz", "dog", "s", "c"]
    k = spark.createDataFrame([(i, w) for i, w in enumerate(kws)], "qid long, keyword string")
    one = {tuple(r) for r in keyword.keyword_batch(c, k, limit=3).collect()}
    monkeypatch.setattr(grams, "HOT_ROWS", 2)
    many = {tuple(r) for r in keyword.keyword_batch(c, k, limit=3).collect()}
    assert one == many and len(one) > 0


def test_keywords_do_not_pass_through_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Classic
    c = spark.createDataFrame([(i, f"row number {i}") for i in range(300)] + [(None, "row number 7")], "id long, corpus string")
    k = spark.createDataFrame([(i, str(i)) for i in range(100)] + [(i, "row") for i in range(100, 150)], "qid long, keyword string")

    def refuse(*a, **kw):
        raise AssertionError("rows reached the driver")
    with monkeypatch.context() as m:
        for name in ("collect", "toArrow", "toPandas"):
            m.setattr(Classic, name, refuse)
        got = keyword.keyword_batch(c, k, limit=2)
    rows = {(r["qid"], r["rank"]): (r["id"], r["matches"]) for r in got.collect()}
    assert rows[120, 1] == (0, 300) and rows[120, 2] == (1, 300) and rows[99, 1] == (99, 3) and rows[7, 2] == (17, sum("7" in str(i) for i in range(300)))


def test_postings_answer_as_the_scan(spark, scratch, monkeypatch):
    """Wildcards, escapes, short and absent keywords; the rare one reads few of the texts."""
    from ragtide.operators import grams
    monkeypatch.setattr(grams, "ID_BLOCK", 16)
    monkeypatch.setattr(grams, "TEXT_BLOCKS", 2)
    words = ["cat", "Katze", "über", "50%", "a_b", "back\\slash", "ΟΔΟΣ", "École"]
    rows = [(i * 3, f"{words[i % 8]} and the row {i} {'needle' if i == 321 else ''}", None, "f") for i in range(400)] + [(5000, None, None, "f")]
    c = spark.createDataFrame(rows, "id long, corpus string, created_at timestamp_ntz, file_name string")
    grams.write_postings(c, scratch + "/p")
    for kw in ["needle", "NEEDLE", "the row 32", "row_32", "a\\_b", "50\\%", "an%row 39", "ca", "%", "_", "über", "ÜBER", "école", "οδος", "nothing such", "back\\\\slash", "ow 12%"]:
        want = [r["id"] for r in keyword.keyword_search(c, kw, 20).collect()]
        got = grams.indexed_search(spark, scratch + "/p", kw, 20)
        assert got.columns == c.columns and [r["id"] for r in got.collect()] == want, kw
    assert 0 < grams.text_share(spark, scratch + "/p", "needle") < 0.1
    assert grams.text_share(spark, scratch + "/p", "nothing such") == 0 and grams.text_share(spark, scratch + "/p", "ca") == 1


def test_keyword_batch_per_keyword_limits(spark):
    texts = ["the cat", "cat", "a cat here", "no", "cats", "the end"]
    c = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "id long, corpus string")
    k = spark.createDataFrame([(1, "cat", 2), (2, "the", None), (3, "cat", 0)],
                              "qid long, keyword string, limit long")
    out = keyword.keyword_batch(c, k, limit=1, limit_col="limit").orderBy("qid", "rank").collect()
    got = [(r["qid"], r["rank"], r["id"], r["matches"]) for r in out]
    # cat: limit 2 of 4 matches; the: NULL limit takes the default 1; limit 0 returns nothing
    assert got == [(1, 1, 1, 4), (1, 2, 2, 4), (2, 1, 1, 2)]


from hypothesis import given, settings, strategies as st  # noqa: E402

_KW = st.text(alphabet=list("ab%_\\éÉ"), min_size=1, max_size=5)     # backslash escapes arise too
_TX = st.text(alphabet=list("abAB%_\\éÉ x"), max_size=12)


@settings(max_examples=10, deadline=None)
@given(st.lists(_TX, min_size=1, max_size=12), st.lists(_KW, min_size=1, max_size=6))
def test_jvm_ilike_and_batch_regex_agree(spark, texts, kws):
    """F1 (Spark ILIKE on the normalised pattern) and F1b (Aho-Corasick or
    the LIKE pattern as a regex) give the same matches."""
    c = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "id long, corpus string")
    k = spark.createDataFrame([(i, w) for i, w in enumerate(kws)], "qid long, keyword string")
    got = {(r["qid"], r["id"]) for r in keyword.keyword_matches(c, k).collect()}
    want = set()
    for q, w in enumerate(kws):
        for r in c.where(ilike_contains("corpus", w)).collect():
            want.add((q, r["id"]))
    assert got == want


def test_no_pair_is_stored_or_shuffled(spark, monkeypatch):
    """Keywords that match every row: what leaves the tiles is a row for each keyword, and only the keywords are stored."""
    from ragtide.operators import grams
    stored = []
    monkeypatch.setattr(grams, "shared_table", lambda df, name: stored.append(name) or df)
    c = spark.createDataFrame([(i, f"the row a {i} {'x' * 40}") for i in range(600)], "id long, corpus string")
    k = spark.createDataFrame([(1, "the", 3), (2, "row", 1), (3, "w a", 2), (4, "%ROW_", 9), (5, "the", 9)], "qid long, keyword string, k long")
    tiles = grams.gram_firsts(c, k.where("qid < 5").select("keyword", "k"))
    assert tiles.groupBy("keyword").agg(F.sum("n").alias("n")).select("n").distinct().collect() == [(600,)]
    assert tiles.where("size(ids) <> least(n, case keyword when 'the' then 3 when 'row' then 1 when 'w a' then 2 else 9 end)").count() == 0
    out = keyword.keyword_batch(c, k, limit_col="k").collect()
    assert {(r["qid"], r["rank"], r["id"], r["matches"]) for r in out} == {(q, i + 1, i, 600) for q, n in ((1, 3), (2, 1), (3, 2), (4, 9), (5, 9)) for i in range(n)}
    assert set(stored) == {"keywords"} and not hasattr(keyword, "shared_table")


def test_slices_and_blocks_of_a_tile_give_same_answer(spark, monkeypatch):
    from ragtide.operators import grams
    texts = ["the cat sat", "Concatenate THE strings", "a_b c", "100% über", "x\0y", "", "line\nbreak cat", "\\ back"] * 4
    c = spark.createDataFrame([(i * 7 % 32, t) for i, t in enumerate(texts)] + [(99, None), (None, "cat")], "id long, corpus string")
    kws = ["cat", "the", "a\\_b", "a_b", "über", "%", "_", "e%cat", "0\\%", "x\0y", "back\\", "the%sat", "s%t%c", "zzz"]
    k = spark.createDataFrame([(i, w) for i, w in enumerate(kws)], "qid long, keyword string")
    want = {(q, r["id"]) for q, w in enumerate(kws) for r in c.where("id is not null").where(ilike_contains("corpus", w)).collect()}
    for name, size in (("SLICE_CHARS", 9), ("SLICE_MARKS", 20), ("TILE_WORDS", 3), ("SKETCH", 4)):
        monkeypatch.setattr(grams, name, size)
        assert {tuple(r) for r in keyword.keyword_matches(c, k).collect()} == want, name
    many = keyword.keyword_batch(c, k, limit=40).collect()
    assert {(r["qid"], r["id"]) for r in many} == want and all(r["matches"] == sum(q == r["qid"] for q, _ in want) for r in many)
