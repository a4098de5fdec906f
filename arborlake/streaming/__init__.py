"""Structured Streaming: entries, progress, incremental re-analysis and logs."""
