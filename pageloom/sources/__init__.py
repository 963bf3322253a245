"""Readers and writers: parquet tables, XML dumps, CSV, JSON, marker-delimited text."""
