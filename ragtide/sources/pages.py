"""S5 page assembly, S8 page summary, K3 extracted-text table.

Input is a page table (file, page_no, text): one row per page, as a PDF
reader would emit.  Blank pages are dropped; the kept pages are joined by
``\\n`` in page order, optionally each under a ``--- Page N ---`` marker.

Assembly runs in two levels so that one file with a huge number of pages is
not gathered in a single task: pages are first concatenated per (file, block
of ``block_pages`` consecutive pages), then the blocks per file.  The block
level is also an output of its own (``assemble_page_blocks``) for files
whose text would not fit in one value, and ``page_parts`` gives parts of bounded size by character.  Counts and
character totals are plain aggregates with map-side combine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragtide.functions.text import is_blank
from ragtide.operators.ids import in_order
from ragtide.session import shared_table

# --- fixed values -----------------------------------------------------------
PAGE_MARKER = "--- Page {n} ---"
# ----------------------------------------------------------------------------

PART_CHARS = 1 << 20         # characters of a part, but for a longer page


def _ordered_join(items_col: str, key: str, val: str, sep: str):
    return F.array_join(F.transform(F.array_sort(F.col(items_col)), lambda x: x[val]), sep)


def _body(marked: bool, page_col: str, text_col: str) -> Column:
    return (F.concat(F.lit("--- Page "), F.col(page_col).cast("string"), F.lit(" ---\n"),
                     F.col(text_col), F.lit("\n")) if marked else F.col(text_col))


def assemble_page_blocks(pages: DataFrame, *, marked: bool = False, block_pages: int = 1024,
                         file_col: str = "file", page_col: str = "page_no",
                         text_col: str = "text") -> DataFrame:
    """S5/F4 at block level: (file, block, text, n_pages), one row per block
    of ``block_pages`` consecutive page numbers that keeps a page.  A file's
    text is its blocks' texts joined by ``\\n`` in block order.  This form
    keeps a file of any size whole: no row holds more than one block."""
    p = pages.where(F.col(text_col).isNotNull() & ~is_blank(text_col))
    p = p.select(F.col(file_col).alias("file"), F.col(page_col).cast("long").alias("page_no"),
                 _body(marked, page_col, text_col).alias("body"))
    return (p.groupBy("file", F.floor(F.col("page_no") / block_pages).cast("long").alias("block"))
            .agg(F.collect_list(F.struct("page_no", "body")).alias("_items"),
                 F.count(F.lit(1)).alias("n_pages"))
            .select("file", "block", _ordered_join("_items", "page_no", "body", "\n").alias("text"),
                    "n_pages"))


def assemble_pages(pages: DataFrame, *, marked: bool = False, block_pages: int = 1024,
                   file_col: str = "file", page_col: str = "page_no", text_col: str = "text") -> DataFrame:
    """(file, text, n_pages, characters) with only non-blank pages: the
    blocks of ``assemble_page_blocks`` joined per file.  One string per file,
    as the reference writes it, so a file's text must fit in one value
    (under 2 GB); beyond that, use the block form."""
    blocks = assemble_page_blocks(pages, marked=marked, block_pages=block_pages, file_col=file_col,
                                  page_col=page_col, text_col=text_col)
    files = (blocks.groupBy("file")
             .agg(F.collect_list(F.struct("block", F.col("text").alias("body"))).alias("_items"),
                  F.sum("n_pages").cast("long").alias("n_pages"))
             .select("file", _ordered_join("_items", "block", "body", "\n").alias("text"), "n_pages"))
    return files.select("file", "text", "n_pages", F.length("text").cast("long").alias("characters"))


def _same_as_before(col: pa.Array) -> np.ndarray:
    """Whether each value but the first equals the one before it; nulls are equal."""
    a, b = col[1:], col[:-1]
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    return pc.or_(pc.fill_null(pc.equal(a, b), False), both).to_numpy(zero_copy_only=False)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's place: the characters of its file before it in this sorted
    partition, a separator after each page.  A file left open by a batch goes on in the next."""
    open_file, run = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        file, size = batch.column("file"), batch.column("_n").to_numpy() + 1
        goes_on = open_file is not None and file[0].as_py() == open_file[0]
        new = np.concatenate([[not goes_on], ~_same_as_before(file)])
        before = np.cumsum(size) - size + (run if goes_on else 0)
        base = np.where(new, before, 0)
        place = before - np.maximum.accumulate(base)
        open_file, run = (file[-1].as_py(),), int(place[-1] + size[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())],
                                         names=[*batch.schema.names, "_place"])


def page_parts(pages: DataFrame, *, marked: bool = False, part_chars: int = PART_CHARS, file_col: str = "file",
               page_col: str = "page_no", text_col: str = "text") -> DataFrame:
    """S5/K3 for a file of any size: (file, part, start, text, n_pages), the file's text in ordered parts.

    A page belongs to part ``start // part_chars``, where ``start`` is the character of the file's text at
    which it begins; so parts do not depend on how the rows were dealt, and a part has fewer than
    ``part_chars`` characters before its last page.  A file's parts joined by ``\\n`` in order are its text; numbers
    are left out where one page covers more than a part.  Pages that share a number follow a hash of their text.

    Pages go to ranges of (file, page number) and are sorted there, so a file with a third of all pages lies in
    many tasks.  A pass over each sorted range adds the characters before each page; the rows are stored, and what
    earlier ranges hold of a range's first file (one number per task, which bounds the broadcast) makes them
    places in the file."""
    p = pages.where(F.col(text_col).isNotNull() & ~is_blank(text_col))
    p = p.select(F.col(file_col).alias("file"), F.col(page_col).cast("long").alias("page_no"),
                 _body(marked, page_col, text_col).alias("body"))
    p = p.withColumn("_n", F.length("body").cast("long")).withColumn("_h", F.xxhash64("body"))
    ordered = in_order(p, ["file", "page_no"], ["_h"])
    placed = ordered.mapInArrow(_places, f"{_ddl(ordered)}, _place long")
    stored = shared_table(placed.withColumn("_t", F.spark_partition_id()), "page-parts")

    earlier = Window.partitionBy("file").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    carry = (stored.groupBy("_t", "file").agg(F.sum(F.col("_n") + 1).alias("_s"))
             .withColumn("_carry", F.sum("_s").over(earlier)).where(F.col("_carry").isNotNull())
             .select(F.col("_t").alias("_ct"), F.col("file").alias("_cf"), "_carry"))
    start = (F.coalesce("_carry", F.lit(0)) + F.col("_place")).alias("start")
    rows = stored.join(F.broadcast(carry), (F.col("_t") == F.col("_ct")) & F.col("file").eqNullSafe(F.col("_cf")), "left")
    return (rows.select("file", start, "body").withColumn("part", F.floor(F.col("start") / part_chars).cast("long"))
            .groupBy("file", "part").agg(F.collect_list(F.struct("start", "body")).alias("_items"),
                                         F.min("start").alias("start"), F.count(F.lit(1)).alias("n_pages"))
            .select("file", "part", "start", _ordered_join("_items", "start", "body", "\n").alias("text"), "n_pages"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in df.dtypes)


def page_summary(pages: DataFrame, *, marked: bool = True, file_col: str = "file",
                 page_col: str = "page_no", text_col: str = "text") -> DataFrame:
    """Pages in the file, pages kept, and characters of the assembled text
    (computed from per-page lengths, without building the text)."""
    blank = F.col(text_col).isNull() | is_blank(text_col)
    page_len = F.length(text_col) + (F.length(F.col(page_col).cast("string")) + len("--- Page  ---\n") + 1
                                     if marked else F.lit(0))
    agg = pages.groupBy(F.col(file_col).alias("file")).agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(F.when(blank, 0).otherwise(1)).cast("long").alias("pages_kept"),
        F.sum(F.when(blank, 0).otherwise(page_len)).cast("long").alias("_chars"))
    # the separators between kept pages add pages_kept - 1 characters
    chars = F.when(F.col("pages_kept") > 0, F.col("_chars") + F.col("pages_kept") - 1).otherwise(0)
    return agg.select("file", "pages", "pages_kept", chars.cast("long").alias("characters"))


def pages_from_lines(docs: DataFrame, *, file_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    """Stand-in page table: each line of a document is a page, page_no the
    1-based line position."""
    return docs.select(F.col(file_col).alias("file"),
                       F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("_i", "text")) \
        .select("file", (F.col("_i") + 1).cast("long").alias("page_no"), "text")


def write_extracted_text(assembled: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K3: the extracted text of every file as one table (file, text), instead
    of one file per document beside its source.  The parts of ``page_parts``
    keep their number and start: (file, part, start, text)."""
    cols = [c for c in ("file", "part", "start", "text") if c in assembled.columns]
    assembled.select(*cols).write.mode(mode).parquet(path)
