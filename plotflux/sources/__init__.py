"""Readers for instrument and laboratory files, and table writers."""
