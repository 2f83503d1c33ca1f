"""Readers and writers of trajectory files and datasets."""
