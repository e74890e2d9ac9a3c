"""Whole pipelines and the bindings that run them on the star-schema tables."""
