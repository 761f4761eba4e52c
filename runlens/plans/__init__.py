"""The three steps a user runs: ingest, build memory, report."""
