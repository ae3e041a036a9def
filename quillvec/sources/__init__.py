"""Corpus, vector-file and manifest readers and writers."""
