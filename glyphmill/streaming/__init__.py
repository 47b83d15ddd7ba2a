"""Structured Streaming: rate limiting and incremental index updates."""
