"""Readers and writers of graphs, and job options."""
