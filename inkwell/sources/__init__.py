"""Readers, writers and the Parquet-backed index store."""
