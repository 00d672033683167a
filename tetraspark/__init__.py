"""Unstructured tetrahedral meshes as Spark DataFrames."""
