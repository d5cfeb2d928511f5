"""Readers of transcripts and tables."""
