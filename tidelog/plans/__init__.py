"""Queries composed of several operators, and the registry of all of them."""
