"""Streaming twins of the polling and incremental operators."""
