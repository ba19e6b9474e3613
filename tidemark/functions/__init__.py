"""Scalar functions over keys, names, paths, routes and filters, as Column expressions."""
