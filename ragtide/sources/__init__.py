"""Readers: parquet tables, text/binary files, page tables, vector literals."""
