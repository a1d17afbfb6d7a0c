"""Structured Streaming forms of the progress and catalog operators."""
