"""Readers, writers and the snapshot manifest."""
