"""Stored tables and search structures: a commit log over Parquet files, and what is kept in it."""
