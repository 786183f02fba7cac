"""Readers and staging: CSV, JSON, grids, links."""
