"""Adapters over the test tables and the catalogue of runnable queries."""
