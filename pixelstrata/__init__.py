"""Raster and corpus analytics on Spark DataFrames."""
