"""Spark jobs for environmental tables: station series, point observations, gridded cells and drainage networks."""
