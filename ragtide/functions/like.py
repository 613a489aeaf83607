"""Case-insensitive substring match with PostgreSQL ILIKE rules.

``%`` and ``_`` in the keyword stay wildcards; ``\\`` escapes the next
character, and a backslash before an ordinary character just yields that
character (PostgreSQL), where Spark would raise.  The pattern is normalised
first so Spark's ``ilike`` accepts it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# keep \%, \_ and \\ ; drop a backslash before any other character
_ESCAPE_RULE = r"(\\[%_\\])|\\(.)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_pattern_literal(keyword: str) -> str:
    """``'%' || keyword || '%'`` with backslash escapes normalised (driver-side
    string work on one literal)."""
    p = "%" + keyword + "%"
    return re.sub(_ESCAPE_RULE, lambda m: m.group(1) or m.group(2), p, flags=re.S)


def contains_pattern(keyword_col) -> Column:
    """Column form of ``contains_pattern_literal`` for a keyword per row."""
    p = F.concat(F.lit("%"), _c(keyword_col), F.lit("%"))
    return F.regexp_replace(p, _ESCAPE_RULE, "$1$2")


def ilike_contains(text, keyword) -> Column:
    """``text ILIKE '%keyword%'``; keyword is a Python string or a Column."""
    if isinstance(keyword, str):
        return _c(text).ilike(contains_pattern_literal(keyword))
    return F.ilike(_c(text), contains_pattern(keyword))
