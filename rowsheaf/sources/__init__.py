"""Readers: CSV tables, physical lines, file inventory, encodings."""
