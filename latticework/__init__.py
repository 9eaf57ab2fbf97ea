"""Spark jobs for points, meshes, graphs, sparse matrices, rankings and pixel tables."""
