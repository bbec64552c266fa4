"""Queries and the projection of the star tables onto the catalogue."""
