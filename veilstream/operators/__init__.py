"""Operators on DataFrames of documents, spans, sessions and events."""
