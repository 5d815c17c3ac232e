"""Nearest-place questions over open map data, as ordinary Spark plans."""
