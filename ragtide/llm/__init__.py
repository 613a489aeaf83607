"""Training-data operators: packing, shingle joins, HTML extraction, sharding,
pseudonyms, vector near-duplicates, mixing, quality rules, language id and
token counts.  Nothing outside this subpackage imports it."""
