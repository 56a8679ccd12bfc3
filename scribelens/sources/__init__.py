"""Readers: every input format becomes a typed DataFrame."""
