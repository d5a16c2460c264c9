"""Structured Streaming: snapshots, windows, search progress."""
