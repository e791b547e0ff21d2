"""Relational operators over files, symbols, chunks and vectors."""
