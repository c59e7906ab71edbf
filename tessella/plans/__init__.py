"""Raster views of the relational tables, and the registered queries with their oracle SQL."""
