"""Readers and writers: trees, feature tables, distance matrices, ordinations, logs."""
