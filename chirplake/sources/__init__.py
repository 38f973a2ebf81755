"""Readers, writers and the views that stand in for catalog tables."""
