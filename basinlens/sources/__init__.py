"""Readers and writers: JSON, CSV, Parquet, GeoJSON, cached report pages."""
