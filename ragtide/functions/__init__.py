"""Column-expression building blocks (JVM-side, no Python per row)."""

from ragtide.functions.text import (  # noqa: F401
    CHUNK_SIZE, LENGTH_LABELS_FR, LENGTH_LABELS_RANGE, PY_WS, base_name, chunk_array,
    decode_fallback, is_blank, iso_timestamp, length_category, line_count,
    normalize_newlines, preview, py_strip, relevance_pct, rounded_avg_display, size_kb,
    snippet,
)
from ragtide.functions.vector import (  # noqa: F401
    as_double_array, cosine_distance, cosine_similarity, dot, l2_distance, norm,
    parse_vector, render_vector, vector_is_valid,
)
from ragtide.functions.like import contains_pattern, contains_pattern_literal, ilike_contains  # noqa: F401
