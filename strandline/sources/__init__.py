"""Readers, catalog scans and writers."""
