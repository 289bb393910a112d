"""Readers, writers and stored logs."""
