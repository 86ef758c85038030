"""Operators of the hierarchy: neighbours, origins, levels, picking."""
