"""Readers, writers and payload flattening."""
