"""Readers and writers of field files."""
