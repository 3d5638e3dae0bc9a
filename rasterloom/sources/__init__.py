"""Readers of rasters, images and the thread catalogue."""
