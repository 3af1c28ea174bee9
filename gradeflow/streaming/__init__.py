"""Structured Streaming forms of the online computations."""
