"""Readers and writers of city formats."""
