"""Operators on meshes: DataFrames in, DataFrames out."""
