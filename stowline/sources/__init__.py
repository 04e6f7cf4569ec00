"""Inventories, directory trees, the operation log, staged tables, text reports."""
