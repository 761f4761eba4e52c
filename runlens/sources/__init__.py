"""Scans, sinks and readers of exported platform tables."""
