"""Shared column-level building blocks (types, order statistics, counts)."""
