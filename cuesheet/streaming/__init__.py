"""Structured Streaming forms; an extension, the batch operators come first."""
