"""Edits that arrive as a stream."""
