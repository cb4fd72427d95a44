"""Readers for stored tables and for delimited files."""
