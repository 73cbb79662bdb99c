"""Incremental runs of the batch upsert over a file stream."""
