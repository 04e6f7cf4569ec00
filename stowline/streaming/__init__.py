"""Inventories that arrive as a stream of manifest files."""
