"""Geospatial features, tiles and routing as Spark DataFrame plans."""
