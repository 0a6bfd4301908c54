"""Readers and writers of the file formats around an assembly."""
