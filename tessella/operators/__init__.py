"""Dataflow operators over rasters and files."""
