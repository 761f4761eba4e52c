"""Registered queries with the DuckDB text that must give the same rows."""
