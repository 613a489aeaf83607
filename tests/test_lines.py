"""Files read in byte ranges against Python's own text-mode reading."""
import os

import pytest
from pyspark.sql import functions as F

from ragtide.operators import chunking
from ragtide.sources import files as files_src
from ragtide.sources import lines as lines_src

CASES = {
    "plain.txt": "one\ntwo\n\nfour\n".encode(),
    "open_end.txt": "one\ntwo".encode(),
    "crlf.txt": b"a\r\nb\r\n\r\nc",
    "cr.txt": b"a\rb\r\rc\r",
    "mixed.txt": b"a\r\r\nb\n\rc\r\n",
    "wide.txt": "näïve\n你好 \U0001f600 end\n \n".encode(),
    "latin.txt": "näïve\ncafé\r\nplain\n".encode("latin-1"),
    "late_latin.txt": ("é ok\n" * 6).encode() + b"\xe9\n",
    "mark.txt": b"\xef\xbb\xbfhead\nnext\n",
    "mark_latin.txt": b"\xef\xbb\xbfhead\ncaf\xe9",
    "only_end.txt": b"\n",
    "only_cr.txt": b"\r",
    "a name.txt": b"<doc>\n     said\n\n  kept\n",
    "empty.txt": b"",
    "other.md": b"not read\n",
}


def _read(raw: bytes):
    try:
        text, enc = raw.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        text, enc = raw.decode("latin-1"), "latin-1"
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return (lines[:-1] if lines[-1] == "" else lines), enc


@pytest.fixture()
def folder(scratch):
    for name, raw in CASES.items():
        with open(os.path.join(scratch, name), "wb") as f:
            f.write(raw)
    return scratch


def _got(lines):
    got = {}
    for r in lines.orderBy("path", "record", "part").collect():
        got.setdefault(r["path"].rsplit("/", 1)[1].replace("%20", " "), []).append(r["line"])
    return got


@pytest.mark.parametrize("size", [1, 2, 3, 5, 1 << 20])
def test_every_cut_gives_the_lines_of_whole_reading(spark, folder, size, monkeypatch):
    conf = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0" if size < 100 else "4194304"}
    old = {k: spark.conf.get(k) for k in conf}
    written = lines_src.shared_table

    def cut(df, name):           # the ranges are those of the text files alone, not of the stored tables
        try:
            for k, v in (conf if name == "lines" else {}).items():
                spark.conf.set(k, v)
            return written(df, name)
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)

    monkeypatch.setattr(lines_src, "shared_table", cut)
    lines, files = lines_src.read_lines(spark, folder)
    got, info = _got(lines), {r["file"]: r for r in files.collect()}
    want = {n: _read(raw) for n, raw in CASES.items() if n.endswith(".txt") and raw}
    assert got == {n: ls for n, (ls, _) in want.items()}
    assert {n: (r["encoding"], r["lines"], r["size_bytes"]) for n, r in info.items()} == \
        {n.replace(" ", "%20") if n not in info else n: (enc, len(ls), len(CASES[n])) for n, (ls, enc) in want.items()}


def test_records_are_dense_in_every_file(spark, folder):
    lines, _ = lines_src.read_lines(spark, folder)
    r = lines.groupBy("path").agg(F.max("record").alias("m"), F.countDistinct("record").alias("n"),
                                  F.min("record").alias("lo")).collect()
    assert all(x["lo"] == 0 and x["m"] + 1 == x["n"] for x in r)


def test_utterances_of_lines_equal_those_of_whole_files(spark, folder):
    lines, _ = lines_src.read_lines(spark, folder)
    mine = chunking.split_lines(lines_src.line_documents(lines), keep=("path",)).select("path", "utterance")
    whole = chunking.split_lines(files_src.read_text_files(spark, folder), text_col="text", keep=("path",))
    tail = lambda df: sorted((r["path"].rsplit("/", 1)[1].replace("%20", " "), r["utterance"]) for r in df.collect())
    assert tail(mine) == tail(whole.select("path", "utterance"))


def test_folder_without_a_match_is_empty(spark, scratch):
    lines, files = lines_src.read_lines(spark, scratch)
    assert lines.count() == 0 and files.count() == 0
