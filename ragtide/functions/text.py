"""Scalar text expressions (all JVM-side Column expressions).

Fixed values that must agree with the reference's behaviour are grouped and
marked below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Chunk size in code points used by the ingest.
CHUNK_SIZE = 500
# Prefix removed once from each utterance line.
UTTERANCE_PREFIX = "     "
# Lines starting with this marker are speaker headers and are dropped.
HEADER_MARKER = "<"
# Length histogram: upper bounds (exclusive) and the labels of both label sets.
LENGTH_BOUNDS = [50, 100, 200, 500]
LENGTH_LABELS_FR = ["Très court (<50)", "Court (50-100)", "Moyen (100-200)",
                    "Long (200-500)", "Très long (>500)"]
LENGTH_LABELS_RANGE = ["0-50", "50-100", "100-200", "200-500", "500+"]
# Preview lengths: stats/recent rows, sources; snippet lengths: console, UI.
PREVIEW_STATS = 100
PREVIEW_SOURCES = 200
SNIPPET_CONSOLE = 80
SNIPPET_UI = 150
ELLIPSIS = "..."
# ----------------------------------------------------------------------------

# Python's str.strip() removes every code point whose str.isspace() is true;
# Spark's trim() only removes U+0020, so we derive the same set by rule.
PY_WS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()`` with Python's whitespace set."""
    return F.btrim(_c(c), F.lit(PY_WS))


def is_blank(c) -> Column:
    return py_strip(c) == F.lit("")


def normalize_newlines(c) -> Column:
    """Text-mode reading: ``\\r\\n`` and lone ``\\r`` become ``\\n``."""
    return F.regexp_replace(_c(c), "\r\n?", "\n")


def decode_fallback(raw) -> Column:
    """utf-8 if the bytes are valid utf-8, else latin-1 (which accepts any
    byte, so later fallbacks of the reference are unreachable)."""
    raw = _c(raw)
    return (F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8"))
            .otherwise(F.decode(raw, "ISO-8859-1")))


def chunk_array(c, size: int = CHUNK_SIZE) -> Column:
    """Consecutive non-overlapping slices of ``size`` code points; the last one
    may be short; empty text gives an empty array.  One regex pass (``.``
    with DOTALL matches one code point, astral characters included), about
    twice as fast as ``substring`` per slice, whose code-point indexing
    rescans the string from its start."""
    s = _c(c)
    return F.regexp_extract_all(s, F.lit("(?s).{1,%d}" % size), 0)


def preview(c, n: int) -> Column:
    """First n code points plus '...' only when the text is longer."""
    s = _c(c)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit(ELLIPSIS))).otherwise(s)


def snippet(c, n: int) -> Column:
    """First n code points plus '...' always."""
    return F.concat(F.substring(_c(c), 1, n), F.lit(ELLIPSIS))


def length_category(c, labels=LENGTH_LABELS_FR) -> Column:
    """Label of the half-open length range the text falls into."""
    n = F.length(_c(c))
    expr = F.lit(labels[-1])
    for bound, label in reversed(list(zip(LENGTH_BOUNDS, labels[:-1]))):
        expr = F.when(n < bound, F.lit(label)).otherwise(expr)
    return expr


def base_name(c) -> Column:
    return F.element_at(F.split(_c(c), "/"), -1)


def size_kb(nbytes) -> Column:
    return F.round(_c(nbytes).cast("double") / 1024.0, 2)


def relevance_pct(sim) -> Column:
    return F.round(_c(sim) * 100.0, 1)


def iso_timestamp(ts) -> Column:
    """``datetime.isoformat()``: the fraction is printed only when non-zero."""
    t = _c(ts)
    frac = F.unix_micros(t.cast("timestamp")) % 1_000_000
    return F.when(frac == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")) \
        .otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def rounded_avg_display(c) -> Column:
    """Nearest integer, halves up (JavaScript Math.round on a positive value)."""
    return F.floor(_c(c) + 0.5).cast("long")


def line_count(raw_text) -> Column:
    """``len(f.readlines())``: an unterminated last line still counts."""
    s = _c(raw_text)
    parts = F.size(F.split(s, "\n", -1))
    return (parts - F.when(s.endswith("\n") | (s == ""), 1).otherwise(0)).cast("long")
