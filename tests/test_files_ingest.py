"""S1-S3 file reading, A9 inventory, K1/K2 corpus table, streaming ingest."""
import os

import pytest
from pyspark.sql import functions as F

from ragtide.operators import ingest
from ragtide.operators.embed import EMBEDDING_DIM
from ragtide.sources import files


def _write(folder, name, data: bytes):
    with open(os.path.join(folder, name), "wb") as fh:
        fh.write(data)


def _fixture_folder(scratch):
    d = os.path.join(scratch, "data")
    os.makedirs(d)
    _write(d, "105_0000006a.txt", b"<01> hotesse\n     h: U B S bonjour\n<02> client\n")
    _write(d, "latin.txt", b"c: \xe9l\xe8ve oui")
    _write(d, "crlf.txt", b"a\r\nb")
    _write(d, "empty.txt", b"")
    _write(d, "blank.txt", "\t   \n".encode())
    _write(d, "notes.md", b"ignored")
    return d


def test_read_and_decode(spark, scratch):
    d = _fixture_folder(scratch)
    got = {r["file"]: r["text"] for r in files.read_text_files(spark, d).collect()}
    assert got["latin.txt"] == "c: élève oui"
    assert got["crlf.txt"] == "a\nb"
    assert "notes.md" not in got
    assert "empty.txt" not in got          # binaryFile skips zero-length files


def test_load_documents_drops_blank(spark, scratch):
    d = _fixture_folder(scratch)
    docs = {r["file"]: r["content"] for r in files.load_documents(spark, d).collect()}
    assert set(docs) == {"105_0000006a.txt", "latin.txt", "crlf.txt"}
    assert len(docs["105_0000006a.txt"]) == 46        # 47 bytes less the final newline


def test_file_inventory(spark, scratch):
    d = _fixture_folder(scratch)
    inv = files.file_inventory(spark, d)
    rows = {r["name"]: (r["size_kb"], r["lines"]) for r in inv.collect()}
    assert rows["105_0000006a.txt"] == (0.05, 3)
    assert rows["crlf.txt"][1] == 2
    assert rows["empty.txt"] == (0.0, 0)                # listed, as the reference lists it
    assert "notes.md" not in rows
    names = [r["name"] for r in inv.collect()]
    assert names[0] == "105_0000006a.txt"              # largest first
    tot = files.inventory_totals(inv).first()
    assert tot["total_files"] == len(rows) and tot["total_lines"] == sum(v[1] for v in rows.values())


def test_corpus_build_write_append(spark, scratch):
    d = _fixture_folder(scratch)
    docs = files.load_documents(spark, d)
    table = os.path.join(scratch, "corpus")
    ingest.write_corpus(ingest.build_corpus(docs), table)
    t = ingest.read_corpus(spark, table)
    rows = t.orderBy("id").collect()
    assert [r["id"] for r in rows] == [1, 2, 3]
    assert [r["file_name"] for r in rows] == ["105_0000006a.txt", "crlf.txt", "latin.txt"]
    assert all(len(r["embedding"]) == EMBEDDING_DIM for r in rows)
    assert len({r["created_at"] for r in rows}) == 1
    # append continues the ids; replacing keeps a readable table
    more = spark.createDataFrame([("z.txt", "x" * 1200, "txt"), ("a.pdf", "page", "pdf")],
                                 "file string, content string, type string")
    assert ingest.append_corpus(more, table) == 7
    ids = [r["id"] for r in ingest.read_corpus(spark, table).orderBy("id").collect()]
    assert ids == list(range(1, 8))
    ingest.write_corpus(ingest.build_corpus(docs), table)
    assert ingest.read_corpus(spark, table).count() == 3


def test_txt_before_pdf_in_id_order(spark):
    docs = spark.createDataFrame([("b.pdf", "p" * 600, "pdf"), ("z.txt", "t", "txt"), ("a.txt", "u", "txt")],
                                 "file string, content string, type string")
    rows = ingest.build_corpus(docs).orderBy("id").collect()
    assert [(r["id"], r["file_name"]) for r in rows] == [(1, "a.txt"), (2, "z.txt"), (3, "b.pdf"), (4, "b.pdf")]


def test_streaming_ingest(spark, scratch):
    from ragtide.streaming.ingest import start_folder_ingest
    d = _fixture_folder(scratch)
    table = os.path.join(scratch, "stream_corpus")
    q = start_folder_ingest(spark, d, table, checkpoint=os.path.join(scratch, "ck"))
    q.awaitTermination(120)
    t = ingest.read_corpus(spark, table)
    assert t.count() == 3
    assert t.agg(F.min("id"), F.max("id")).first() == (1, 3)
    # new file: only it is ingested on the next run, ids continue
    _write(d, "later.txt", b"plus tard")
    q = start_folder_ingest(spark, d, table, checkpoint=os.path.join(scratch, "ck"))
    q.awaitTermination(120)
    t = ingest.read_corpus(spark, table)
    assert sorted(r["id"] for r in t.collect()) == [1, 2, 3, 4]


def test_streaming_epoch_rerun_is_idempotent(spark, scratch):
    from ragtide.streaming.ingest import epoch_writer
    table = os.path.join(scratch, "epochs")
    write = epoch_writer(table, "s1")
    b0 = spark.createDataFrame([("a.txt", "x" * 700, "txt"), ("b.txt", "y", "txt")],
                               "file string, content string, type string")
    b1 = spark.createDataFrame([("c.txt", "z", "txt")], "file string, content string, type string")
    write(b0, 0)
    first = sorted((r["id"], r["corpus"]) for r in ingest.read_corpus(spark, table).collect())
    write(b0, 0)                      # the same epoch run again after a failure
    again = sorted((r["id"], r["corpus"]) for r in ingest.read_corpus(spark, table).collect())
    assert first == again and [i for i, _ in first] == [1, 2, 3]
    write(b1, 1)
    write(b1, 1)
    ids = sorted(r["id"] for r in ingest.read_corpus(spark, table).collect())
    assert ids == [1, 2, 3, 4]
    # a batch append at the root continues after the streamed rows
    more = spark.createDataFrame([("d.txt", "w", "txt")], "file string, content string, type string")
    assert ingest.append_corpus(more, table) == 5


def test_a_load_that_runs_again_replaces_its_rows_alone(spark, scratch):
    docs = [spark.createDataFrame([(f"{k}.txt", "t" * 600, "txt")], "file string, content string, type string") for k in "abc"]
    table = os.path.join(scratch, "t")
    for d, load in zip(docs, "abc"):
        ingest.append_corpus(d, table, load=load)

    def stamps(load):
        folder = os.path.join(table, f"load={load}")
        return sorted(os.listdir(folder))
    before, want = {x: stamps(x) for x in "ab"}, sorted((r["id"], r["file_name"]) for r in ingest.read_corpus(spark, table).collect())
    assert ingest.append_corpus(docs[2], table, load="c") == 6
    assert {x: stamps(x) for x in "ab"} == before
    assert sorted((r["id"], r["file_name"]) for r in ingest.read_corpus(spark, table).collect()) == want
    assert ingest.max_id(spark, table, "c") == 4 and ingest.max_id(spark, os.path.join(scratch, "none")) == 0


def test_utterance_table(spark, scratch):
    d = _fixture_folder(scratch)
    path = os.path.join(scratch, "utterances")
    with_lines = files.read_text_files(spark, d).select("file", F.col("text").alias("content"))
    ingest.write_corpus(ingest.build_utterances(with_lines), path)
    t = ingest.read_corpus(spark, path, ingest.UTTERANCE_SCHEMA).orderBy("id")
    assert t.columns == ["id", "corpus", "embedding", "created_at"]
    assert [(r["id"], r["corpus"]) for r in t.collect()] == [
        (1, "h: U B S bonjour"), (2, "\t \u00a0 "), (3, "a"), (4, "b"), (5, "c: élève oui")]
    assert {len(r["embedding"]) for r in t.collect()} == {EMBEDDING_DIM}
    assert ingest.build_utterances(with_lines.limit(0)).count() == 0


def test_null_text_fails_the_write(spark, tmp_path):
    ok = ingest.build_corpus(spark.createDataFrame([("a.txt", "one two", "txt")], "file string, content string, type string"))
    bad = ok.unionByName(ok.withColumn("corpus", F.lit(None).cast("string")))
    with pytest.raises(Exception, match="NULL corpus"):
        ingest.write_corpus(bad, str(tmp_path / "t"))


def test_inventory_lists_names_with_spaces_once(spark, tmp_path):
    (tmp_path / "a b.txt").write_text("x\ny\n")
    (tmp_path / "c%20d.txt").write_text("")
    rows = files.file_inventory(spark, str(tmp_path)).collect()
    assert [(r["name"], r["lines"]) for r in rows] == [("a b.txt", 2), ("c%20d.txt", 0)]


def test_stream_progress_is_found_again(spark, scratch, monkeypatch):
    """One file stays one file over three starts without ``checkpoint=``; no shared folder, no start."""
    from ragtide.streaming import ingest as stream
    import pytest
    d, table = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    os.makedirs(d)
    _write(d, "one.txt", b"un")
    monkeypatch.setattr(stream, "checkpoint_dir", lambda s: None)
    with pytest.raises(ValueError):
        stream.start_folder_ingest(spark, d, table)
    monkeypatch.setattr(stream, "checkpoint_dir", lambda s: os.path.join(scratch, "shared"))
    for _ in range(3):
        stream.start_folder_ingest(spark, d, table).awaitTermination(120)
        assert ingest.read_corpus(spark, table).count() == 1
