"""Connectors: trees of files, archives, and remote archives."""
