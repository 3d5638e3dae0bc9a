"""Settings and the whole way from a raster to a plan."""
