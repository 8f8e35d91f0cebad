"""Readers for the source files and their normalisation into the graph tables."""
