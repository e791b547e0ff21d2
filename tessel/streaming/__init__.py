"""Streaming: files and job events as they arrive."""
