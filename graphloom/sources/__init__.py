"""Readers, writers and the mapping of plain tables onto the model."""
