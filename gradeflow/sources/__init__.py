"""Readers, writers and the model catalogue."""
