"""Readers and writers: fixed-schema table scans, derived fixtures, card files."""
