"""DataFrame-to-DataFrame operators on rasters, catalogues, regions and patterns.

A raster has one row a pixel: img, i (= y * width + x), x, y and value columns; ``img`` partitions
everything, so any number of images goes through one plan.
"""
