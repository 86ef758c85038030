"""Inputs: geometry columns, dense row index, masks."""
