"""Readers and writers of the text and JSON formats."""
