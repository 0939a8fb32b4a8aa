"""Readers, writers and the adapter views that turn given tables into trajectory tables."""
