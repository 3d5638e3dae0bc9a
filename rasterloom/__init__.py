"""Raster-to-plan analytics on Spark: pixels as rows, a thread catalogue as a dimension table."""
