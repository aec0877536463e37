"""Readers and builders of bar tables and file catalogs."""
