"""Readers, writers and the binding of logical tables to stored ones."""
