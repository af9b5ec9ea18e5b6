"""Readers that turn files, pages and query results into document rows."""
