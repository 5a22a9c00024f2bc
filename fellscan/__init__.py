"""Terrain-anomaly analytics on Spark: elevation surfaces, point clouds, candidates and detections as DataFrames."""
