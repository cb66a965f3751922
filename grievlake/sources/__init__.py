"""Readers, writers and storage locations."""
