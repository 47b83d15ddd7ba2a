"""Corpus scans, the index store, stop-word files, log and export sinks."""
