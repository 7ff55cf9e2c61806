"""Whole queries: read views, and the catalogue that the driver runs."""
