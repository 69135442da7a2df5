"""Readers of archive files, paged trade histories and instrument lists, and sinks."""
