"""Footprint analytics on Spark: lidar footprints, patches, rasters and plots as DataFrames."""
