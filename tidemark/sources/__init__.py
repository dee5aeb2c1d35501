"""Readers, writers and source profiles."""
