"""Readers, source shapes and writers."""
