"""Structured Streaming form of the incremental run."""
